"""The rules that the stored procedures of a database would hold, as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name and parameters: what it returns.
FUNCTIONS = {
    "file_key(file_id string, url string)": "if(file_id is not null, concat('id:', file_id), concat('url:', sha2(url, 256)))",
    "preserves_title(title string, original string, easy string, changes array<struct<start: int>>)": """coalesce(startswith(original, concat(title, '\\n')) and startswith(easy, concat(title, '\\n'))
        and substr(original, length(title) + 2) rlike '\\\\S' and substr(easy, length(title) + 2) rlike '\\\\S' and forall(changes, c -> c.start >= length(title) + 1), false)""",
    "retry_seconds(attempts int)": "cast(least(3600, 30 * power(2, least(attempts - 1, 10))) as bigint)",
    "unique_place(body string, quote string)": "if(length(quote) > 0 and instr(body, quote) > 0 and instr(substr(body, instr(body, quote) + 1), quote) = 0, instr(body, quote) - 1, null)",
    "kst_day(at timestamp)": "to_date(from_utc_timestamp(at, 'Asia/Seoul'))",
}


#: Functions that give a table, over the views that ``register_tables`` makes.
TABLE_FUNCTIONS = {
    "notice_dictionary_entries(id bigint)": (
        "ordinal int, query_word string, state string, retry_after bigint",
        """select l.ordinal, l.query_word,
            case when c.n_entries > 0 then 'found' when c.n_entries = 0 then 'not_found' when c.lease_expires_at > c.asked_at then 'pending' when c.last_error_code is not null then 'failed' else 'unprocessed' end,
            case when c.n_entries is null and (c.lease_expires_at > c.asked_at or c.last_error_code is not null) then cast(least(3600, greatest(0, ceil(
                (unix_micros(if(c.lease_expires_at > c.asked_at, c.lease_expires_at, c.retry_after_at)) - unix_micros(c.asked_at)) / 1000000))) as bigint) else 0 end
        from dictionary_links l left join dictionary_cache c on c.cache_key = l.cache_key and c.query_word = l.query_word where l.notice_id = id""",
    ),
    "notice_dictionary(id bigint)": (
        "n_candidates bigint, status string, retry_after bigint",
        """select count(*), case when count_if(state = 'failed') > 0 then 'partial' when count_if(state = 'pending') > 0 then 'pending' when count_if(state = 'unprocessed') > 0 then 'unprocessed' else 'complete' end, max(retry_after)
        from (select case when c.n_entries > 0 then 'found' when c.n_entries = 0 then 'not_found' when c.lease_expires_at > c.asked_at then 'pending' when c.last_error_code is not null then 'failed' else 'unprocessed' end as state,
            case when c.n_entries is null and (c.lease_expires_at > c.asked_at or c.last_error_code is not null) then cast(least(3600, greatest(0, ceil(
                (unix_micros(if(c.lease_expires_at > c.asked_at, c.lease_expires_at, c.retry_after_at)) - unix_micros(c.asked_at)) / 1000000))) as bigint) else 0 end as retry_after
          from dictionary_links l left join dictionary_cache c on c.cache_key = l.cache_key and c.query_word = l.query_word where l.notice_id = id)
        having count(*) > 0""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    return [signature.split("(")[0] for signature in FUNCTIONS]


def register_tables(links, cache, now: str) -> list[str]:
    """Creates the table functions over links (notice_id, ordinal, query_word, cache_key) and cache (cache_key, query_word, n_entries, lease_expires_at, retry_after_at, last_error_code) as of a time; returns their names.

    In SQL: select * from notices n, lateral notice_dictionary(n.id).
    """
    spark = links.sparkSession
    links.createOrReplaceTempView("dictionary_links")
    cache.selectExpr("*", f"timestamp '{now}' as asked_at").createOrReplaceTempView("dictionary_cache")
    for signature, (columns, query) in TABLE_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} returns table({columns}) return {query}")
    return [signature.split("(")[0] for signature in TABLE_FUNCTIONS]
