"""Operational records: counters and histograms, rate limits, audit and feedback, jobs, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.settings import Settings

# Upper bounds of histogram buckets.
REQUEST_MS = (50, 100, 250, 500, 1000, 2000, 5000)
RISK = (0.2, 0.4, 0.6, 0.8, 1.0)
COVERAGE = (0.25, 0.5, 0.75, 1.0)
SYNTHESIS_MS = (100, 250, 500, 1000, 2000, 5000, 10000, 20000)
EXEMPT = ("/health", "/metrics", "/docs", "/redoc", "/openapi.json", "/ui")


def counters(rows: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    """(labels, n, total): events of each label, and the sum of whole values."""
    aggs = [F.count("*").alias("n")] + ([F.sum(F.greatest(F.lit(0), F.col(value)).cast("long")).alias("total")] if value else [])
    return rows.groupBy(*labels).agg(*aggs)


def histogram(rows: DataFrame, labels: list[str], value: str, bounds: Sequence[float], clamp: bool = False) -> DataFrame:
    """(labels, le, n): cumulative buckets; those without events are absent. Each event falls in one bucket, which is counted before the shuffle; only buckets are summed up."""
    v = T.clamp01(F.col(value).cast("double")) if clamp else F.col(value)
    first = F.array_min(F.filter(F.array(*(F.lit(i) for i in range(len(bounds) + 1))), lambda i: (i == len(bounds)) | (v <= F.get(F.array(*(F.lit(float(b)) for b in bounds)), i))))
    sized = rows.where(F.col(value).isNotNull()).withColumn("_b", first).groupBy(*labels, "_b").agg(F.count("*").alias("c"))
    each = sized.select(*labels, "c", F.explode(F.sequence(F.col("_b"), F.lit(len(bounds)))).alias("_b"))
    names = F.array(*(F.lit(f"{b:g}") for b in bounds), F.lit("+Inf"))
    return each.groupBy(*labels, F.get(names, F.col("_b")).alias("le")).agg(F.sum("c").alias("n"))


def term_key(terms: Column) -> Column:
    """Sorted distinct lower-case terms, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(terms, F.lower))), ",")


def tag_counts(rows: DataFrame, tags: str = "tags") -> DataFrame:
    tag = F.lower(T.strip(F.col("tag")))
    return rows.select(F.explode(tags).alias("tag")).groupBy(tag.alias("tag")).agg(F.count("*").alias("n")).where("tag <> ''")


def quantile(buckets: DataFrame, labels: list[str], q: float = 0.95, upper: float | None = None) -> DataFrame:
    """(labels, value): linear interpolation within the bucket that holds the rank, as dashboards do; above the last bound, that bound."""
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    order = Window.partitionBy(*labels).orderBy("_le")
    rows = buckets.withColumn("_le", le)
    rows = rows.withColumns({"_total": F.max("n").over(Window.partitionBy(*labels)), "_low": F.coalesce(F.lag("_le").over(order), F.lit(0.0)), "_below": F.coalesce(F.lag("n").over(order), F.lit(0))})
    hit = rows.where(F.col("n") >= q * F.col("_total")).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    inside = F.col("_low") + (F.col("_le") - F.col("_low")) * (q * F.col("_total") - F.col("_below")) / (F.col("n") - F.col("_below"))
    return hit.select(*labels, F.when(F.col("_le") == float("inf"), F.col("_low")).otherwise(inside).alias("value"))


def rates(rows: DataFrame, labels: list[str], span: str = "5 minutes", step: str | None = None) -> DataFrame:
    """(labels, window_start, n, per_second) over windows of event time ``ts``."""
    w = F.window("ts", span, step) if step else F.window("ts", span)
    seconds = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).cast("double")
    return rows.withColumn("w", w).groupBy(*labels, "w").agg(F.count("*").alias("n")).select(*labels, F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("per_second"))


def minute(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 60)


def rate_counts(rows: DataFrame, client: str = "client") -> DataFrame:
    """(client, minute, n) of requests(client, ts)."""
    return rows.groupBy(client, minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("n"))


def rate_decisions(rows: DataFrame, settings: Settings = Settings(), client: str = "client", seconds: int = 60) -> DataFrame:
    """rows plus ``allowed``: the first requests of a client in each fixed window; exempt paths and a limit of 0 let everything pass."""
    if settings.rate_limit <= 0:
        return rows.withColumn("allowed", F.lit(True))
    exempt = F.col("path").isin(*EXEMPT) if "path" in rows.columns else F.lit(False)
    place = Window.partitionBy(client, "_w", "_x").orderBy("ts", *(c for c in ("request_id",) if c in rows.columns))
    held = rows.withColumns({"_w": F.floor(F.unix_timestamp("ts") / seconds), "_x": exempt})
    return held.withColumn("allowed", F.col("_x") | (F.row_number().over(place) <= settings.rate_limit)).drop("_w", "_x")


def exempt(path: Column) -> Column:
    return path.isin(*EXEMPT)


def key_tenants(mapping: dict[str, str], listed: str) -> dict[str, str]:
    """Tenants of API keys: the mapping first, then listed keys as their own tenants."""
    out = {k.strip(): v.strip() for k, v in mapping.items() if k.strip() and v.strip()}
    for k in listed.split(","):
        if k.strip():
            out.setdefault(k.strip(), k.strip())
    return out


def authenticate(requests: DataFrame, keys: dict[str, str]) -> DataFrame:
    """requests(api_key, …) plus the key's tenant, null if unknown."""
    table = requests.sparkSession.createDataFrame(list(keys.items()), "api_key string, tenant string")
    return requests.join(F.broadcast(table), "api_key", "left")


def tenant(authenticated: Column, stated: Column, default: Column) -> Column:
    return F.coalesce(T.falsy(authenticated, ""), T.falsy(stated, ""), default)


def page_size(n: int | None, settings: Settings = Settings()) -> int:
    return max(1, min(settings.page_max, settings.page_default if n is None else n))


def decode_cursor(cursor: str | None) -> tuple[float, int] | None:
    """(created_at, id) of a cursor; None if it isn't one."""
    try:
        at, row = (cursor or "").split("|")
        return float(at), int(row)
    except ValueError:
        return None


def audit_page(audit: DataFrame, user_id: str | None = None, limit: int | None = None, after: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """One page, newest first, behind a cursor. The comparison reaches the scan, and only a page's rows are sorted out of each task."""
    rows = audit if user_id is None else audit.where(F.col("user_id") == user_id)
    if (at := decode_cursor(after)) is not None:
        rows = rows.where((F.col("created_at") < at[0]) | ((F.col("created_at") == at[0]) & (F.col("id") < at[1])))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(page_size(limit, settings))


def feedback_list(feedback: DataFrame, limit: int | None = None, min_rating: int | None = None, settings: Settings = Settings()) -> DataFrame:
    rows = feedback if min_rating is None else feedback.where(F.col("rating") >= min_rating)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(page_size(limit, settings))


def training_rows(audit: DataFrame, feedback: DataFrame, min_rating: int | None = None, limit: int | None = None, rated_only: bool = False) -> DataFrame:
    """Audit rows with the rating and comment of their (user, query). Of several ratings the oldest among the newest ``limit`` counts; a lower rating than the least only leaves them empty."""
    rated = feedback if min_rating is None else feedback.where(F.col("rating") >= min_rating)
    logs = audit
    if limit is not None:
        logs, rated = (df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit) for df in (audit, rated))
    oldest = rated.groupBy("user_id", "query").agg(F.min_by(F.struct("rating", "comment"), F.struct("created_at", "id")).alias("_f"))
    out = logs.join(oldest, ["user_id", "query"], "inner" if rated_only else "left")
    return out.withColumns({"rating": F.col("_f.rating"), "comment": F.col("_f.comment")}).drop("_f")


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, kind, status, created_at, started_at, finished_at, error) of job events(job_id, kind, event, ts, error)."""
    at = lambda *e: F.max(F.when(F.col("event").isin(*e), F.col("ts")))
    rows = events.groupBy("job_id").agg(F.first("kind", ignorenulls=True).alias("kind"), at("queued").alias("created_at"), at("running").alias("started_at"), at("succeeded", "failed").alias("finished_at"), F.max_by("event", F.struct("ts", F.col("event").isin("succeeded", "failed"))).alias("status"), F.max("error").alias("error"))
    return rows.select("job_id", "kind", "status", "created_at", "started_at", "finished_at", "error")


def prune_jobs(jobs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Drops the oldest finished jobs down to the number kept; unfinished ones stay."""
    extra = max(0, jobs.count() - settings.jobs_kept)
    if not extra:
        return jobs
    old = jobs.where(F.col("status").isin("succeeded", "failed")).orderBy("created_at", "job_id").limit(extra).select("job_id")
    return jobs.join(old, "job_id", "left_anti")


def cache_put(cache: DataFrame | None, rows: DataFrame, now: float, ttl_s: float) -> DataFrame:
    """cache(key, value, expires_at) with rows(key, value) in place of older ones."""
    new = rows.select("key", "value", F.lit(now + ttl_s).alias("expires_at"))
    return new if cache is None else cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def cache_get(cache: DataFrame, keys: DataFrame, now: float) -> DataFrame:
    """keys plus ``value``, null if there is none or it has expired."""
    return keys.join(cache.where(F.col("expires_at") > now).select("key", "value"), "key", "left")


METRIC_HELP = {
    "requests_total": "How many requests came, by their labels",
    "request_latency_ms_total": "Milliseconds that requests took, summed up",
    "request_latency_ms_bucket": "Requests that took so many milliseconds or fewer",
    "author_queries_total": "Questions that name an author",
    "author_gap_total": "Questions whose author has no passage with their words",
    "retrieval_failures_total": "Answers by the tag of what went wrong in retrieval",
    "hallucination_risk_bucket": "Answers of such a risk or a lower one",
    "evidence_coverage_bucket": "Answers of such a coverage or a lower one",
    "synthesis_total": "Answers by how their writing ended",
    "synthesis_latency_ms_total": "Milliseconds of writing answers, by how it ended",
    "synthesis_latency_ms_bucket": "Answers written in so many milliseconds or fewer",
}


def exposition(series: dict[str, tuple[DataFrame, list[str], str]], prefix: str = "engine") -> str:
    """The text that a metrics endpoint returns. series[name] is (rows, labels, value column); there are as many rows as label values."""
    out = []
    for name, (rows, labels, value) in series.items():
        kind = "histogram" if name.endswith("_bucket") else "counter"
        out += [f"# HELP {prefix}_{name} {METRIC_HELP.get(name, name)}", f"# TYPE {prefix}_{name} {kind}"]
        for r in rows.select(*labels, value).orderBy(*labels).collect():
            said = ",".join(f'{label}="{r[label]}"' for label in labels)
            out.append(f"{prefix}_{name}{{{said}}} {r[value]}")
    return "\n".join(out) + "\n"
