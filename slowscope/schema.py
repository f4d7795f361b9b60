"""Shape of the entries table, and statement labels."""

from __future__ import annotations

ENTRY_SCHEMA = (
    "entry_id bigint, file_path string, log_time timestamp, log_time_offset_minutes int, set_timestamp bigint, "
    "user_name string, sys_user_name string, host_name string, ip_address string, thread_id bigint, "
    "query_time double, lock_time double, rows_sent bigint, rows_examined bigint, extra string, use_database string, "
    "sql string, statement_kind string, sql_type string, objects array<struct<schema_name:string,object_name:string>>, "
    "context struct<request_id:string,caller:string,function:string,line:bigint>, comment_map map<string,string>, "
    "masked_values array<string>, _trailing string, _corrupt_record string, _corrupt_reason string"
)

ANALYSIS_SCHEMA = "valid boolean, sql string, sql_type string, objects array<struct<schema_name:string,object_name:string>>, masked_values array<string>"

ADMIN, SQL, INVALID = "admin", "sql", "invalid"

#: Label of a valid statement that no other label fits, and of entries without a type in counts.
UNKNOWN = "NULL"
