"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _TS, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Access and error lines share one table; a column that does not apply is null.
ENTRIES = _struct(
    id=_S, timestamp=_L, ip=_S, region_code=_S, province=_S, city=_S, city_id=_L, c1=_S, c2=_S, c3=_S, c4=_S, method=_S, path=_S, path_exact=_S, protocol=_S, status=_I, bytes_sent=_L, referer=_S, user_agent=_S,
    browser=_S, browser_version=_S, os=_S, os_version=_S, device_type=_S, request_time=_D, upstream_time=_D, file_path=_S, main_log_path=_S, raw=_S, level=_S, sub1=_S, sub2=_S, city_point=_S,
)

#: One row per log file.
FILE_STATE = _struct(
    id=_S, created_at=_TS, updated_at=_TS, path=_S, main_log_path=_S, last_modified=_TS, last_size=_L, last_position=_L, last_indexed=_TS, index_start_time=_TS, index_duration=_L, timerange_start=_TS, timerange_end=_TS,
    document_count=_L, enabled=_B, fingerprint=_S, sync_version=_I, index_status=_S, error_message=_S, error_time=_TS, retry_count=_I, queue_position=_I,
)

#: Log files that the host's configuration names.
HOST_LOGS = _struct(path=_S, type=_S, source=_S, config_file=_S)

#: Lines as the source reads them.
RAW_LINES = _struct(raw=_S, offset=_L, file_path=_S, main_log_path=_S, fingerprint=_S, position=_L, rewritten=_B)

#: Ranges of addresses with a location, by the keys of their first and last address (``geo.address_key``, ``geo.network_keys``).
GEO_RANGES = _struct(lo=_S, hi=_S, region_code=_S, province=_S, city=_S, city_id=_L, latitude=_D, longitude=_D, sub1_iso=_S, sub2_iso=_S)

STATUSES = ("not_indexed", "queued", "indexing", "indexed", "error")
