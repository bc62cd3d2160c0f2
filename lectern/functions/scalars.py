"""Scalar rules as Column expressions; all stay in the JVM.

Truncation follows doubles (never decimals), rounding is Spark's half-up on the decimal form, and minutes are padded
with ``format_string``, never ``lpad`` (which would cut 105 to 10).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size limits, clamps, thresholds and the session-title pattern of the domain.
MIN_HEALTHY_BYTES = 1024 * 1024
MIN_HEALTHY_SECONDS = 30.0
WORKERS_LEAST, WORKERS_MOST = 4, 32
COMPLETE_SHARE = 0.95
BLANK_VARIANCE = 500.0
AUDIO_EXTENSIONS = ("mp3", "wav", "m4a", "aac", "flac", "ogg", "wma")
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "flv", "wmv", "webm")
STATUS_LABELS = {-2: "starting", 0: "downloading", 1: "merging", 2: "done", -1: "failed"}
SESSION_TITLE = r"第\d+周\s+星期[一二三四五六日天]\s+第\d+大节"
FORBIDDEN_IN_NAMES = '\\/:*?"<>|'


def _int(x: Column) -> Column:
    return F.floor(x).cast("int")


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with truncated milliseconds."""
    s = seconds.cast("double")
    return F.format_string("%02d:%02d:%02d,%03d", _int(s / 3600), _int((s % 3600) / 60), _int(s % 60), _int((s % 1) * 1000))


def minute_time(seconds: Column) -> Column:
    """MM:SS; minutes go beyond 99."""
    s = seconds.cast("double")
    return F.format_string("%02d:%02d", _int(s / 60), _int(s % 60))


def clock_time(seconds: Column) -> Column:
    """MM:SS below an hour, else HH:MM:SS."""
    s = seconds.cast("double")
    return F.when(s >= 3600, F.format_string("%02d:%02d:%02d", _int(s / 3600), _int((s % 3600) / 60), _int(s % 60))).otherwise(minute_time(s))


def parse_time(text: Column) -> Column:
    """Seconds of H:M:S or M:S; another number of parts gives 0, a part that is no integer null."""
    p = F.split(text, ":", -1)
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(p) == 2, part(1) * 60 + part(2)).otherwise(F.lit(0))


LINE_PATTERN = r"^\[([0-9:]+)-([0-9:]+)\]\s*(.*)$"


def transcript_line(line: Column) -> Column:
    """struct(start, end, text) of ``[start-end] text``; null for any other line."""
    get = lambda i: F.regexp_extract(line, LINE_PATTERN, i)
    return F.when(line.rlike(LINE_PATTERN), F.struct(parse_time(get(1)).alias("start"), parse_time(get(2)).alias("end"), get(3).alias("text")))


def is_short_line(text: Column) -> Column:
    """Digits and dots alone, or at most three characters."""
    return text.rlike(r"^[0-9.]+$") | (F.length(text) <= 3)


def strip(text: Column) -> Column:
    """Trim of all Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|(?U)\s+$", "")


def sanitize_name(text: Column, *, trimmed: bool = True) -> Column:
    """Forbidden file-name characters become underscores."""
    out = F.translate(text, FORBIDDEN_IN_NAMES, "_" * len(FORBIDDEN_IN_NAMES))
    return strip(out) if trimmed else out


def session_titles(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SESSION_TITLE), F.lit(0))


def history_label(key: Column, name: Column, professor: Column, count: Column, most: int = 28) -> Column:
    """Parts joined by spaced middle dots; a long name is cut and ends in an ellipsis."""
    name, professor = strip(F.coalesce(name, F.lit(""))), strip(F.coalesce(professor, F.lit("")))
    short = F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 1), F.lit("…"))).otherwise(name)
    shown = F.when(name != "", F.when(professor != "", F.concat(short, F.lit(" · "), professor)).otherwise(short))
    return F.concat_ws("  ·  ", key, shown, F.concat(F.coalesce(F.nullif(count, F.lit(0)), F.lit(1)).cast("string"), F.lit(" 次")))


def iso_minute(text: Column) -> Column:
    """YYYY-MM-DD HH:MM of an ISO text."""
    return F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 16)


def human_bytes(n: Column, largest: str = "TB") -> Column:
    """Size in the unit below which it stays under 1024, ``largest`` at most; one decimal of the exact value, ties to even."""
    n = n.cast("double")
    units = ("B", "KB", "MB", "GB", "TB")
    last = units.index(largest)
    # format_number rounds the exact binary value, as printf does; format_string rounds the shortest decimal, half up.
    shown = [F.concat(F.call_function("format_number", n / 1024.0**power, F.lit("0.0")), F.lit(f" {unit}")) for power, unit in enumerate(units)]
    out = shown[last]
    for power in reversed(range(last)):
        out = F.when(n < 1024.0 ** (power + 1), shown[power]).otherwise(out)
    return out


def throughput(size: Column, seconds: Column) -> Column:
    """MB/s with 2 decimals; elapsed below 0.01 s counts as that."""
    return F.round(size / 1048576.0 / F.greatest(seconds, F.lit(0.01)), 2)


def per_segment_ms(seconds: Column, segments: Column) -> Column:
    return F.round(seconds * 1000.0 / F.greatest(segments, F.lit(1)), 1)


def percent(done: Column, total: Column) -> Column:
    """Truncated; 0 without a total."""
    return F.when(total > 0, F.floor(100.0 * done / total)).otherwise(F.lit(0)).cast("int")


def overall_percent(index: Column, files: Column, current: Column, total: Column) -> Column:
    """Percent over files, the current one in part."""
    return F.floor((index / files + current / total / files) * 100.0).cast("int")


def backoff(attempt: Column, base: float = 0.5, most: float = 8.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def clamp(x: Column, least: int = WORKERS_LEAST, most: int = WORKERS_MOST) -> Column:
    return F.greatest(F.lit(least), F.least(x, F.lit(most)))


def complete(present: Column, total: Column, share: float = COMPLETE_SHARE, *, strict: bool = False) -> Column:
    """Enough segments are there; ``strict`` wants all of them."""
    return present >= total if strict else present >= share * total


def healthy(size: Column, seconds: Column) -> Column:
    return (size >= MIN_HEALTHY_BYTES) & (seconds >= MIN_HEALTHY_SECONDS)


def status_label(status: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, label in STATUS_LABELS.items():
        out = out.when(status == code, label)
    return out.otherwise("")


def error_class(message: Column) -> Column:
    """First of proxy, timeout, ssl that the message shows; else other."""
    low = F.lower(message)
    return (
        F.when(message.contains("ProxyError") | low.contains("proxy"), "proxy")
        .when(low.contains("timeout") | low.contains("timed out"), "timeout")
        .when(message.contains("SSLError") | low.contains("certificate"), "ssl")
        .otherwise("other"))


def fetch_error_class(message: Column, absent: tuple[str, ...]) -> Column:
    """Classes of a failed look-up: proxy, absent (the message holds one of the given phrases), else other."""
    missing = F.lit(False)
    for phrase in absent:
        missing = missing | message.contains(phrase)
    return F.when(F.lower(message).contains("proxy"), "proxy").when(missing, "absent").otherwise("other")


def reachable(*endpoints: Column) -> Column:
    """All endpoints answered; one that is not known did not."""
    out = F.lit(True)
    for e in endpoints:
        out = out & F.coalesce(e, F.lit(False))
    return out


def succeeded(status: Column, word: str) -> Column:
    """The status text holds the word of success."""
    return F.coalesce(status.contains(word), F.lit(False))


def probed_duration(text: Column) -> Column:
    """Seconds that a media probe has printed; anything but a number that is not negative counts as a failure, 0."""
    seconds = F.trim(text).try_cast("double")
    return F.when((seconds >= 0) & (seconds < float("inf")), seconds).otherwise(F.lit(0.0))


def reusable_audio(size: Column, duration: Column) -> Column:
    """An extracted 16 kHz mono 16-bit file is kept: above 1,000 bytes and a tenth of what the duration asks for."""
    return size > F.greatest(F.lit(1000.0), F.greatest(duration, F.lit(0.0)) * 32000 * 0.1)


def has_output(size: Column, least: int = 1000) -> Column:
    """An output file counts as made if it is larger than ``least`` bytes."""
    return F.coalesce(size > least, F.lit(False))


def http_hint(status: Column) -> Column:
    return F.when(status == 403, "token may be expired").when(status == 404, "video missing or deleted").otherwise("")


def probe_state(ok: Column, error: Column, code: Column, http: Column, proxied: Column, busy_code: int) -> Column:
    """Ordered states of a connectivity probe; waf (the service's ``busy_code``) tells whether a proxy was on."""
    refused = code.isin(401, 403) | http.isin(401, 403)
    return (
        F.when(ok, "ok").when(F.coalesce(error, F.lit("")) != "", "neterr")
        .when(code == busy_code, F.when(proxied, "waf-proxy").otherwise("waf-token")).when(refused, "unauth").otherwise("unknown"))


def first_url(*candidates: Column) -> Column:
    """First that is neither null nor empty; none: empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute links stay, rooted ones go below the host, others beside the base document."""
    plain = F.regexp_replace(base, r"[?#].*$", "")
    host = F.regexp_extract(plain, r"^([a-z]+://[^/]+)", 1)
    folder = F.when(plain.rlike(r"^[a-z]+://[^/]+/"), F.regexp_replace(plain, r"/[^/]*$", "")).otherwise(plain)
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, F.lit("/"), link))


def bandwidth(line: Column) -> Column:
    """Value of the last BANDWIDTH= of the line (AVERAGE-BANDWIDTH counts too); none: 0."""
    found = F.regexp_extract_all(line, F.lit(r"BANDWIDTH=([0-9]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("long"), F.lit(0))


def key_uri(line: Column) -> Column:
    return F.regexp_extract(line, r'URI="([^"]*)"', 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def spec_pair(text: Column, default: int = 16) -> Column:
    """struct(name, k) of ``name:k``; without k the default."""
    k = F.try_element_at(F.split(text, ":", 2), F.lit(2)).try_cast("int")
    return F.struct(F.split_part(text, F.lit(":"), F.lit(1)).alias("name"), F.coalesce(k, F.lit(default)).alias("k"))


def course_spec(text: Column) -> Column:
    """struct(course_id, folder) of ``digits:folder``; anything else is null."""
    key, folder = strip(F.substring_index(text, ":", 1)), strip(F.regexp_replace(text, "^[^:]*:", ""))
    return F.when(text.contains(":") & key.rlike("^[0-9]+$") & (folder != ""), F.struct(key.alias("course_id"), folder.alias("folder")))


def similarity(a: Column, b: Column) -> Column:
    """1 - Hamming / bits of two arrays of 64-bit words; empty: 0."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, 1 - bits / (F.size(a) * 64.0)).otherwise(F.lit(0.0))


def saturation(link: Column, per_connection: Column) -> Column:
    return link / per_connection


def total_time(segments: Column, size: Column, workers: Column, link: Column, per_connection: Column, setup: float = 0.2, fail: float = 0.02, wait: float = 1.0, merge: float = 2.0) -> Column:
    """Transfer (bounded by link or connections) + set-up + expected retries + merge."""
    moved = segments * size
    return F.greatest(moved / link, moved / (workers * per_connection)) + segments * setup / workers + segments * fail * wait + merge


def clamp_segment(start: Column, end: Column, offset: Column, duration: Column) -> Column:
    """struct(start, end): offset added, both within [0, duration], end not before start."""
    a = F.greatest(F.lit(0.0), F.least(start + offset, duration))
    return F.struct(a.alias("start"), F.greatest(a, F.least(end + offset, duration)).alias("end"))
