"""Codecs, coercions, fingerprints and metric lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


EPOCH = "1970-01-01 00:00:00"


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("bigint")


def from_epoch(seconds: Column) -> Column:
    """Timestamp without zone, in UTC, of seconds since 1970 (fractions to the microsecond)."""
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


#: Fixed value: the shape of RFC 3339 times.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


def rfc3339(text: Column) -> Column:
    """UTC without zone of RFC 3339 text, null for any other shape; independent of the session's zone."""
    plain = F.regexp_replace(F.regexp_replace(text, ",", "."), r"(\.\d{6})\d+", "$1")
    micros = F.unix_micros(F.when(F.regexp_like(text, F.lit(RFC3339)), F.try_to_timestamp(plain)))
    return from_epoch(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"))


def member(job_id: Column, partition: Column, offset: Column) -> Column:
    return F.concat_ws(":", job_id, partition.cast("string"), offset.cast("string"))


def parse_member(text: Column) -> Column:
    """(job_id, partition, offset) split from the right, null where it is no member."""
    part = lambda i: F.regexp_extract(text, r"^(.+):(\d+):(\d+)$", i)
    return F.when(F.regexp_like(text, F.lit(r"^.+:\d+:\d+$")), F.struct(part(1).alias("job_id"), part(2).cast("int").alias("partition_id"), part(3).cast("bigint").alias("offset")))


def composite(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def fire_id(schedule_id: Column, fire_at: Column) -> Column:
    return F.format_string("sched-%d-%d", schedule_id, epoch(fire_at))


def canonical_json(text: Column) -> Column:
    """Keys sorted at every level, compact, without HTML escapes; null where it does not parse."""
    return F.to_json(F.try_parse_json(text))


def fingerprint(worker_class: Column, payload: Column) -> Column:
    """Digest of class and canonical payload; equal jobs have equal fingerprints."""
    return F.md5(F.concat(worker_class, F.lit("\0"), F.coalesce(canonical_json(payload), F.lit("{}"))).cast("binary"))


def _seeding(seed: int) -> int:
    """The bigint whose ``xxhash64`` is ``seed``. The built-in function starts from 42 and hashes a column with what the ones
    before gave as its seed, so this one in front chooses the seed; each step of the hash of eight bytes can be undone.
    """
    whole, p1, p2, p3, p4, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    undo = lambda p: pow(p, -1, 1 << 64)
    turned = lambda x, n: ((x << n) | (x >> (64 - n))) & whole
    h = seed & whole
    h ^= h >> 32
    h = h * undo(p3) & whole
    h ^= (h >> 29) ^ (h >> 58)
    h = h * undo(p2) & whole
    h ^= h >> 33
    h = turned((h - p4) * undo(p1) & whole, 64 - 27) ^ ((42 + p5 + 8) & whole)
    x = turned(h * undo(p1) & whole, 64 - 31) * undo(p2) & whole
    return x - (1 << 64) if x >> 63 else x


def xxh64(text: Column, seed: int = 0) -> Column:
    """XXH64 of a text's UTF-8 bytes under any seed, as a bigint; null where the text is."""
    return F.when(text.isNotNull(), F.xxhash64(F.lit(_seeding(seed)), text))


def parity_fingerprint(worker_class: Column, payload: Column) -> Column:
    """Byte-compatible variant: two seed-0 XXH64 digests, the second salted, little-endian hex."""
    m = F.concat(worker_class, F.lit("\0"), F.coalesce(canonical_json(payload), F.lit("{}")))
    both = F.concat(*[F.lpad(F.hex(xxh64(x)), 16, "0") for x in (m, F.concat(m, F.lit("\0uniq_salt_v1")))])
    digests = [F.substring(both, 1 + 16 * i + 14 - 2 * k, 2) for i in (0, 1) for k in range(8)]
    return F.lower(F.concat(*digests))


def truthy(text: Column, default: bool = False) -> Column:
    """1, true, yes and on are true; a missing or empty text is the default, anything else false."""
    given = F.coalesce(text, F.lit("")) != ""
    return F.when(given, F.lower(F.trim(text)).isin("1", "true", "yes", "on")).otherwise(default)


def to_int(text: Column, default: int = 0) -> Column:
    """A decimal integer without blanks, else the default."""
    return F.coalesce(F.when(F.regexp_like(text, F.lit(r"^[+-]?\d+$")), text).try_cast("bigint"), F.lit(default).cast("bigint"))


def to_float(text: Column, default: float = 0.0) -> Column:
    """A decimal or scientific number, infinity or NaN without blanks, else the default."""
    shape = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
    return F.coalesce(F.when(F.regexp_like(text, F.lit(shape)), text).try_cast("double"), F.lit(float(default)))


def decoded_map(text: Column) -> Column:
    """JSON object as a map of texts; null where it is empty or no object."""
    return F.when(F.regexp_like(text, F.lit(r"^\s*\{")) & F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>"))


def split_urls(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,\n\r]"), lambda x: F.trim(x)), lambda x: x != "")


def metric_name(event: Column) -> Column:
    return F.replace(event, F.lit("."), F.lit("_"))


def tags(values: Column, most: int = 128) -> Column:
    """Sorted ``#k:v`` tags of a map; nulls, payloads, errors and long values are left out."""
    keep = F.map_filter(values, lambda k, v: v.isNotNull() & ~k.isin("payload", "error") & (F.char_length(v) <= most))
    pairs = F.transform(F.array_sort(F.map_entries(keep)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("|#"), F.array_join(pairs, ","))).otherwise("")


def statsd(event: Column, duration_ms: Column, values: Column) -> Column:
    """A counter line, or a timing line where there is a duration."""
    body = F.when(duration_ms.isNull(), F.lit(":1|c")).otherwise(F.concat(F.lit(":"), F.round(duration_ms).cast("bigint").cast("string"), F.lit("|ms")))
    return F.concat(metric_name(event), body, tags(values))


def dsn(text: Column) -> Column:
    """mysql:// and mysql2:// URLs as user:password@tcp(host:port)/database?parameters, port 3306 by default.

    Parameters are sorted and escaped; any other text is a native string and only trimmed; a URL
    without a host is null.
    """
    t = F.trim(text)
    rest = F.regexp_replace(t, r"^[^:]*://", "")
    authority, path = F.regexp_extract(rest, r"^([^/?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*/([^?#]*)", 1)
    user, place = F.regexp_extract(authority, r"^(.*)@", 1), F.regexp_replace(authority, r"^.*@", "")
    host, port = F.regexp_replace(place, r":\d*$", ""), F.regexp_extract(place, r":(\d+)$", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    # the first value of a parameter counts
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(decoded(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(x, r"=(.*)$", 1)).alias("v")))
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    values = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.url_encode(F.filter(pairs, lambda p: p["k"] == k)[0]["v"])))
    url = F.concat(
        F.transform(F.array(user), lambda u: F.when(u != "", F.concat(decoded(u), F.lit("@"))).otherwise(""))[0], F.lit("tcp("), host, F.lit(":"),
        F.when(port == "", "3306").otherwise(port), F.lit(")/"), decoded(path), F.when(F.size(values) > 0, F.concat(F.lit("?"), F.array_join(values, "&"))).otherwise(""),
    )
    return F.when(~F.regexp_like(t, F.lit("^(?i:mysql2?)://")), t).when(host != "", url)


def decrypt(blob: Column, salt: str) -> Column:
    """AES-256-GCM text of base64 JSON {v, iv, tag, ct}; the key is the salt's SHA-256."""
    import hashlib

    from pyspark.sql import types as T

    doc = F.from_json(F.unbase64(blob).cast("string"), T.StructType([T.StructField(k, T.StringType()) for k in ("v", "iv", "tag", "ct")]))
    raw = F.concat(F.unbase64(doc["iv"]), F.unbase64(doc["ct"]), F.unbase64(doc["tag"]))
    return F.try_aes_decrypt(raw, F.lit(hashlib.sha256(salt.encode()).digest()), F.lit("GCM"), F.lit("DEFAULT")).cast("string")


#: Payloads of this many bytes and more are stored compressed.
LEAST_GZIP = 256


def packed_payload(payload: Column) -> Column:
    """(payload, encoding): gzip from LEAST_GZIP bytes on, else the bytes as they are."""
    import gzip

    @F.pandas_udf("payload binary, encoding string")
    def pack(raw: pd.Series) -> pd.DataFrame:
        big = [b is not None and len(b) >= LEAST_GZIP for b in raw]
        return pd.DataFrame({"payload": [gzip.compress(b, mtime=0) if g else b for b, g in zip(raw, big, strict=True)], "encoding": ["gzip" if g else "" for g in big]})

    return pack(payload.cast("binary"))


def raw_payload(payload: Column, encoding: Column) -> Column:
    """The bytes that ``packed_payload`` took; null where compressed bytes are damaged."""
    import gzip
    import zlib

    @F.pandas_udf("binary")
    def unpack(raw: pd.Series, how: pd.Series) -> pd.Series:
        def one(b, e):
            try:
                return gzip.decompress(b) if e == "gzip" and b is not None else b
            except (OSError, EOFError, zlib.error):
                return None

        return pd.Series([one(b, e) for b, e in zip(raw, how, strict=True)], dtype=object)

    return unpack(payload, encoding)


def murmur2(key: Column) -> Column:
    """The 32-bit Murmur2 that brokers' clients hash keys with, as a non-negative integer."""
    import numpy as np

    #: Fixed values of the hash.
    seed, m = np.uint32(0x9747B28C), np.uint32(0x5BD1E995)

    def hashed(keys: np.ndarray, n: int) -> np.ndarray:
        """Keys of one length, a row of bytes each."""
        h = np.full(len(keys), seed ^ np.uint32(n), np.uint32)
        words = keys[:, : n // 4 * 4].reshape(len(keys), n // 4, 4).astype(np.uint32)
        for i in range(n // 4):
            k = (words[:, i] << np.arange(0, 32, 8, dtype=np.uint32)).sum(1, dtype=np.uint32) * m
            h = h * m ^ (k ^ k >> np.uint32(24)) * m
        if n % 4:
            tail = keys[:, n // 4 * 4 :].astype(np.uint32)
            h = (h ^ (tail << np.arange(0, 8 * (n % 4), 8, dtype=np.uint32)).sum(1, dtype=np.uint32)) * m
        h = (h ^ h >> np.uint32(13)) * m
        return (h ^ h >> np.uint32(15)) & np.uint32(0x7FFFFFFF)

    @F.pandas_udf("bigint")
    def of(keys: pd.Series) -> pd.Series:
        raw = keys.map(lambda x: None if x is None else x.encode())
        size, out = raw.map(lambda b: -1 if b is None else len(b)).to_numpy(), np.full(len(raw), -1, np.int64)
        for n in np.unique(size[size >= 0]).tolist():
            at = np.flatnonzero(size == n)
            out[at] = hashed(np.frombuffer(b"".join(raw.iloc[at]), np.uint8).reshape(len(at), n), n)
        return pd.Series(out).where(out >= 0, None).astype("Int64")

    return of(key)


def random_id() -> Column:
    """A random UUID; runs differ."""
    return F.uuid()


def derived_id(*parts: Column) -> Column:
    """An identifier in UUID form that follows from its parts; runs agree."""
    h = F.md5(composite(*[p.cast("string") for p in parts]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
