"""Column functions over urls, times, progress, usage records, secrets, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of each stage of a run in its progress.
STAGE_WEIGHTS = (0.40, 0.20, 0.30, 0.05, 0.05)
RETRYABLE = ("timeout", "timed out", "rate limit", "connection", "temporarily", "overloaded", "502", "503", "504", "429")


def url_source(url: Column, root: Column) -> Column:
    """owner, repo, repo_type, source of a repository url; a local path counts as local with its last segment."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.regexp_extract(url, r"^[^@/]+@([^:/]+):", 1)))
    tail = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(\.git)?/*$", "")
    parts = F.filter(F.split(F.regexp_replace(tail, r"^(\w+://[^/]*/?|[^@/]+@[^:/]+:)", ""), "/"), lambda x: x != "")
    kind = F.when(host.contains("github"), "github").when(host.contains("gitlab"), "gitlab").when(host.contains("bitbucket"), "bitbucket").when(host.contains("gitee"), "gitee").otherwise("git")
    local = url.isNull() | (F.trim(url) == "")
    return F.struct(
        F.when(~local & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-2))).alias("owner"),
        F.when(local, F.substring_index(F.regexp_replace(root, r"/+$", ""), "/", -1)).otherwise(F.try_element_at(parts, F.lit(-1))).alias("repo"),
        F.when(local, "local").otherwise(kind).alias("repo_type"),
        F.when(local, root).otherwise(url).alias("source"),
    )


def clean_github_url(url: Column) -> Column:
    """https://github.com/owner/repo for the usual spellings; null for others."""
    m = lambda k: F.regexp_extract(F.trim(url), r"^(?:https?://)?(?:www\.)?(?:git@)?github\.com[/:]([\w.-]+)/([\w.-]+?)(?:\.git)?/?$", k)
    return F.when(m(1) != "", F.concat(F.lit("https://github.com/"), m(1), F.lit("/"), m(2)))


def job_id_of(full_name: Column) -> Column:
    """owner/repo as a job id, and back."""
    return F.replace(full_name, F.lit("/"), F.lit("--"))


def full_name_of(job_id: Column) -> Column:
    return F.replace(job_id, F.lit("--"), F.lit("/"))


def endpoint(base: Column, path: str) -> Column:
    """A base url with its version (``/v1`` where it has none) and a path."""
    tidy = F.regexp_replace(base, r"/+$", "")
    return F.concat(F.when(tidy.rlike(r"/v\d+$"), tidy).otherwise(F.concat(tidy, F.lit("/v1"))), F.lit(path))


def valid_url(url: Column, require_https: bool = False, allow_localhost: bool = True) -> Column:
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.try_parse_url(url, F.lit("HOST"))
    local = host.isin("localhost", "127.0.0.1")
    ok = scheme.isin("http", "https") & host.isNotNull()
    if require_https:
        ok = ok & ((scheme == "https") | local)
    return F.coalesce(ok if allow_localhost else ok & ~local, F.lit(False))


def masked(secret: Column, visible: int = 4) -> Column:
    """The ends of a secret; only stars where it is too short for both."""
    return F.when(F.length(secret) <= 2 * visible, F.repeat(F.lit("*"), F.length(secret))).otherwise(F.concat(F.substring(secret, 1, visible), F.lit("..."), F.right(secret, F.lit(visible))))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def within_days(created: Column, now: Column, days: int) -> Column:
    return created > now - F.expr(f"INTERVAL {days} DAYS")


def cooled_down(last: Column, now: Column, minutes: int = 3) -> Column:
    return last <= now - F.expr(f"INTERVAL {minutes} MINUTES")


def overall_progress(stage: Column, within: Column, weights: tuple[float, ...] = STAGE_WEIGHTS) -> Column:
    """Progress of a run in its 1-based stage, within which a share is done; clamped to 0 and 1."""
    share = F.least(F.greatest(within, F.lit(0.0)), F.lit(1.0))
    out = F.lit(0.0)
    for i, w in enumerate(weights, start=1):
        out = out + F.when(stage > i, w).when(stage == i, share * w).otherwise(0.0)
    return out


def eta_seconds(elapsed: Column, progress: Column) -> Column:
    return F.when(progress > 0, elapsed / progress - elapsed)


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def retry_delay(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Exponential backoff without its random part."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def is_retryable(message: Column) -> Column:
    return F.lower(message).rlike("|".join(RETRYABLE))


def usage_of(record: Column) -> Column:
    """prompt, completion and total tokens of a usage record (JSON) by either naming; the total defaults to their sum."""
    get = lambda *names: F.coalesce(*[F.get_json_object(record, f"$.{n}").cast("long") for n in names])
    prompt = F.coalesce(get("prompt_tokens", "request_tokens", "input_tokens"), F.lit(0))
    completion = F.coalesce(get("completion_tokens", "response_tokens", "output_tokens"), F.lit(0))
    return F.struct(prompt.alias("prompt"), completion.alias("completion"), F.coalesce(get("total_tokens"), prompt + completion).alias("total"))


def without_keys(json: Column, *keys: str) -> Column:
    """A JSON object without some of its top-level keys."""
    as_map = F.from_json(json, "map<string,string>")
    return F.to_json(F.map_filter(as_map, lambda k, _: ~k.isin(*keys)))


def unfenced(answer: Column) -> Column:
    """An answer without the fence of its code block."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```\w*\s*", ""), r"\s*```$", ""))


def repaired_json(text: Column, schema: str) -> Column:
    """A JSON answer: as it is, unfenced, with single quotes and trailing commas repaired, or its outermost braces."""
    plain = unfenced(text)
    commas = lambda c: F.regexp_replace(c, r",\s*([}\]])", "$1")
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    tries = [plain, commas(plain), commas(F.translate(plain, "'", '"')), braces, commas(F.translate(braces, "'", '"'))]
    found = [F.from_json(t, schema, {"mode": "PERMISSIVE"}) for t in tries]
    ok = [F.when(F.try_parse_json(t).isNotNull(), f) for t, f in zip(tries, found, strict=True)]
    return F.coalesce(*ok)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
