"""Table schemas and the guard applied when reading tables of any age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "events": (
        "source_key string, service string, date string, host string, seq bigint, ts_ns bigint, kind string, worker_id int,"
        " tid int, task_id bigint, waker_task_id bigint, spawn_loc string, instrumented boolean, local_queue int,"
        " cpu_time_ns bigint, sched_wait_ns bigint, source int, callchain array<bigint>, span_id bigint, parent_span_id bigint,"
        " span_name string, size bigint, addr bigint, alloc_ts_ns bigint, fields map<string,string>"),
    "samples": (
        "ts_ns bigint, stack_id string, worker_id int, source int, source_key string, poll_duration_ns bigint,"
        " spawn_location string, metadata map<string,string>,"
        " enclosing_spans array<struct<span_uid:string,span_type_uid:string,elapsed_ns:bigint,details_complete:boolean>>"),
    "stacks": "stack_id string, frames array<string>",
    "polls": (
        "source_key string, start_ns bigint, end_ns bigint, duration_ns bigint, worker_id int, task_id bigint, spawn_loc string,"
        " ready_at_ns bigint, scheduling_delay_ns bigint, scheduling_delay_kind int, waker_task_id bigint,"
        " task_instrumented boolean, cpu_sample_count int, sched_sample_count int"),
    "spans": (
        "source_key string, span_uid string, span_type_uid string, kind string, name string, target string, callsite_file string,"
        " callsite_line int, start_ns bigint, end_ns bigint, elapsed_ns bigint, active_ns bigint, observed_active_wall_ns bigint,"
        " detail_coverage_ns bigint, details_complete boolean, concurrent boolean, parent_span_uid string, on_cpu_ns_est bigint,"
        " blocked_ns_est bigint, async_wait_ns bigint, scheduler_delay_ns bigint, unknown_ns bigint, cpu_sample_count int,"
        " sched_sample_count int, attribution_version int, attribution_flags int, unbalanced_exits int, unbalanced_enters int,"
        " identity_quality string, attributes map<string,string>"),
}

# Columns without which a row means nothing; the others may be absent in old tables.
REQUIRED = {
    "events": ("source_key", "seq", "ts_ns", "kind"),
    "samples": ("ts_ns", "stack_id", "source"),
    "stacks": ("stack_id", "frames"),
    "polls": ("start_ns", "end_ns", "duration_ns"),
    "spans": ("span_uid", "span_type_uid", "start_ns", "end_ns", "elapsed_ns"),
}


def table_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


def _loose(kind: T.DataType) -> str:
    return kind.simpleString()


def _fitted(column: Column, kind: T.DataType) -> Column:
    """Cast of an integer that raises where the value would change."""
    narrow = column.cast(kind)
    return F.when(column.isNull() | (narrow.cast("bigint") == column.cast("bigint")), narrow).otherwise(F.raise_error(F.lit("value out of range")).cast(kind))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order. An absent optional column reads as null. Another integer type is cast, and a value that doesn't
    fit raises; any other type, and an absent required column, is an error."""
    have = {f.name: f.dataType for f in df.schema}
    columns = []
    for field in table_schema(table):
        found = have.get(field.name)
        if found == field.dataType:
            columns.append(F.col(field.name))
        elif found is None and field.name not in REQUIRED[table]:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif found is not None and (isinstance(found, T.NullType) or isinstance(found, T.IntegralType) and isinstance(field.dataType, T.IntegralType)):
            columns.append(_fitted(F.col(field.name), field.dataType).alias(field.name))
        elif found is not None and _loose(found) == _loose(field.dataType):
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))  # differs in nullability inside only
        else:
            raise TypeError(f"{table}.{field.name}: need {field.dataType.simpleString()}, have {found.simpleString() if found else 'nothing'}")
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in table_schema(table)}]
    return df.select(*columns, *extra)
