"""Scalar functions as column expressions. Everything here stays in the JVM and inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PPM = 1_000_000

# --- text --------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """The set of lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def trigrams(text: Column) -> Column:
    """The set of three-character windows of the lower-cased text; empty for shorter texts. Made by zipping the characters
    with themselves, in time proportional to the length."""
    chars = F.split(F.lower(text), "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(F.zip_with(pairs, F.slice(chars, F.lit(3), F.size(chars)), lambda a, b: F.concat(a, b))))


def jaccard_ppm(shared: Column, left: Column, right: Column) -> Column:
    """Integer Jaccard similarity in millionths from the sizes of the intersection and the two sets; 0 if one is empty. Null
    where repeated rows share as much as both sides have."""
    return F.when((left == 0) | (right == 0), F.lit(0)).otherwise(F.call_function("div", shared.cast("long") * PPM, F.nullif(left + right - shared, F.lit(0)))).cast("long")


def token(value: Column) -> Column:
    """Unicode-trimmed value. ASCII is already in composed form; other text goes through `canonical.nfc`."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def unix_lines(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


CONTROLS = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]"


def strip_controls(value: Column) -> Column:
    """CR and CRLF become LF; C0 controls but tab and LF, DEL and C1 controls go."""
    return F.regexp_replace(unix_lines(value), CONTROLS, "")


def stripped_controls(value: Column) -> Column:
    return (F.length(unix_lines(value)) - F.length(strip_controls(value))).cast("long")


#: What counts as a secret, in the order in which they are looked for: (reason, pattern, replacement).
SECRETS = (
    ("private_key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED:PRIVATE_KEY]"),
    ("private_key_material", r"\bMII[A-Za-z0-9+/=]{20,}\b", "[REDACTED:PRIVATE_KEY]"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED:JWT]"),
    ("authorization", r"(?i)(authorization\s*:\s*(?:bearer|basic)\s+)[^\s'\";]+", "$1[REDACTED]"),
    ("assignment", r"(?i)(api[_-]?key|token|secret|password|passwd|access[_-]?key)(\s*[:=]\s*[\"']?)([A-Za-z0-9_./+=-]{8,})", "$1$2[REDACTED]"),
    ("provider_token", r"\b(?:sk[-_](?:live[-_]|test[-_])?|api[-_]|tok[-_]|key[-_])[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED]"),
)
ENTROPY_TOKEN = r"[A-Za-z0-9_+/=-]{32,}"
ENTROPY_BITS = 4.2


#: Strings of which one is in every text that a pattern fits, of patterns that ignore case in lower case.
HINTS = {
    "private_key": ("-----BEGIN ",), "private_key_material": ("MII",), "jwt": ("eyJ",), "authorization": ("authorization",), "assignment": ("key", "token", "secret", "passw"),
    "provider_token": ("sk-", "sk_", "api-", "api_", "tok-", "tok_", "key-", "key_"), "aws_access_key": ("AKIA", "ASIA"),
}


def bound(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def redact(value: Column) -> tuple[Column, dict[str, Column]]:
    """(redacted value, matches by reason): each pattern sees what the earlier ones left, and texts without one of its hints
    are passed on unread."""

    def step(reason: str, pattern: str, replacement: str):
        def then(s: Column) -> Column:
            text = F.lower(s["text"]) if pattern.startswith("(?i)") else s["text"]
            return bound(F.struct(s["text"].alias("text"), s["n"].alias("n"), bound(text, lambda t: reduce(lambda x, y: x | y, [t.contains(F.lit(h)) for h in HINTS[reason]])).alias("may")), found)

        def found(s: Column) -> Column:
            n = F.when(s["may"], F.regexp_count(s["text"], F.lit(pattern)).cast("long")).otherwise(F.lit(0).cast("long"))
            return F.struct(F.when(s["may"], F.regexp_replace(s["text"], pattern, replacement)).otherwise(s["text"]).alias("text"), F.concat(s["n"], F.array(n)).alias("n"))

        return then

    state = F.struct(strip_controls(value).alias("text"), F.array().cast("array<long>").alias("n"))
    for secret in SECRETS:
        state = bound(state, step(*secret))

    def last(s: Column) -> Column:
        high = F.size(F.filter(F.regexp_extract_all(s["text"], F.lit(f"({ENTROPY_TOKEN})"), 1), is_high_entropy)).cast("long")
        some = s["text"].rlike(ENTROPY_TOKEN)
        return F.when(some, F.struct(redact_entropy(s["text"]).alias("text"), F.concat(s["n"], F.array(high)).alias("n"))).otherwise(F.struct(s["text"].alias("text"), F.concat(s["n"], F.array(F.lit(0).cast("long"))).alias("n")))

    state = bound(state, last)
    reasons = [*(reason for reason, _, _ in SECRETS), "high_entropy"]
    return state["text"], {reason: state["n"][i] for i, reason in enumerate(reasons)}


def redact_entropy(value: Column) -> Column:
    """The value with every high-entropy token replaced: what lies between tokens is zipped with the tokens, so a token
    is replaced in its place and not wherever its characters occur."""
    between = F.split(value, ENTROPY_TOKEN, -1)
    tokens = F.regexp_extract_all(value, F.lit(f"({ENTROPY_TOKEN})"), 1)
    kept = F.transform(tokens, lambda t: F.when(is_high_entropy(t), "[REDACTED]").otherwise(t))
    return F.array_join(F.zip_with(between, F.concat(kept, F.array(F.lit(""))), lambda b, t: F.concat(b, t)), "")


def holds_credentials(value: Column) -> Column:
    """Any of the patterns; no entropy test, since evidence legitimately carries hashes."""
    out = F.lit(False)
    for _, pattern, _ in SECRETS:
        out = out | F.coalesce(value.rlike(pattern), F.lit(False))
    return out


def entropy_bits(value: Column) -> Column:
    """Shannon entropy of a token's characters, bits per character."""
    chars = F.split(value, "")
    n = F.length(value)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - _share(chars, c, n) * F.log2(_share(chars, c, n)))


def _share(chars: Column, c: Column, n: Column) -> Column:
    return F.size(F.filter(chars, lambda x: x == c)) / n


def is_high_entropy(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (entropy_bits(value) >= ENTROPY_BITS)


def relative_path(value: Column) -> Column:
    """Cleaned relative path with forward slashes; null for absolute paths and those that leave their root."""
    p = F.replace(token(value), F.lit("\\"), F.lit("/"))
    kept = F.aggregate(
        F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")),
        F.array().cast("array<string>"),
        lambda s, x: F.when((x == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))),
    )
    clean = F.when(F.size(kept) == 0, F.lit(".")).otherwise(F.array_join(kept, "/"))
    bad = p.startswith("/") | p.rlike("^[A-Za-z]:") | (clean == "..") | clean.startswith("../")
    return F.when(~bad, clean)


def normalized_set(values: Column) -> Column:
    """Trimmed, without empty members, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, token), lambda x: x != "")))


def is_normalized_set(values: Column) -> Column:
    return values == normalized_set(values)


# --- numbers -----------------------------------------------------------------------------------------------------


def micros(value: Column) -> Column:
    """Decimal string to millionths, halves up; null if it is no number in [0, 1]."""
    number = value.try_cast("decimal(38,18)")
    return F.when((number >= 0) & (number <= 1), F.round(number * PPM, 0).cast("long"))


def score_micros(value: Column) -> Column:
    """Database score to millionths, halves away from zero; null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value * PPM).cast("long"))


def wilson_ppm(successes: Column, samples: Column, z_squared_ppm: int) -> Column:
    """Largest whole ppm not above the Wilson lower bound. The closed form in doubles lands on it or next to it; the
    exact test in DECIMAL(38) decides between the neighbours, for samples up to a billion."""
    z = z_squared_ppm / PPM
    s, n = successes.cast("double"), samples.cast("double")
    p = s / n
    lower = (p + z / (2 * n) - F.sqrt(z * (p * (1 - p) / n + z / (4 * n * n)))) / (1 + z / n)
    guess = F.floor(lower * PPM)
    fixed = guess
    for near in (guess - 1, guess, guess + 1):
        fixed = F.when((near >= 0) & wilson_holds(near, successes, samples, z_squared_ppm), near).otherwise(fixed)
    return F.when((samples <= 0) | (successes > samples), F.lit(0)).otherwise(F.greatest(fixed, F.lit(0))).cast("long")


def wilson_holds(m: Column, s: Column, n: Column, z: int) -> Column:
    """Whether m ppm is at or below the bound: the smaller root of n(nq+z)m^2 - n(2sq+z)qm + s^2 q^3 (q = 10^6), all
    divided by q^2 so that the products fit 38 digits."""
    d = lambda c: c.cast("decimal(38,0)")
    q = F.lit(PPM).cast("decimal(38,0)")
    m, s, n, z = d(m), d(s), d(n), F.lit(z).cast("decimal(38,0)")
    left = 2 * m * (n * q + z) <= q * (2 * s * q + z)
    value = n * ((n * q + z) * m * m - (2 * s * q + z) * m * q) + s * s * q * q * q
    return left & (value >= 0)


def quantize(vector: Column, scale: int) -> Column:
    """Unit vector times scale, rounded half away from zero."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.round(x / norm * scale).cast("long"))


def inner_product(a: Column, b: Column) -> Column:
    """Exact integer score; ANSI arithmetic raises when it leaves 64 bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def negative_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s - x)


# --- versions, hashes, time --------------------------------------------------------------------------------------


SEMVER = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"


def semver(version: Column) -> Column:
    """A struct that orders as versions do (with or without `v`); null for what is no version. After major, minor and
    patch a release comes after its prereleases; their parts compare as numbers, numbers before words, fewer before
    more. Build metadata does not count."""
    part = lambda i: F.regexp_extract(version, SEMVER, i)
    number = lambda x: x.rlike(r"^\d+$")
    one = lambda x: F.struct((~number(x)).alias("word"), F.when(number(x), x.cast("decimal(38,0)")).otherwise(0).alias("n"), F.when(number(x), "").otherwise(x).alias("text"))
    pre = F.transform(F.filter(F.split(part(4), r"\."), lambda x: x != ""), one)
    key = F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), (part(4) == "").alias("release"), pre.alias("pre"))
    return F.when(part(1) != "", key)


def nul_hash(*values: Column) -> Column:
    """SHA-256 over the values with NUL between them."""
    return F.sha2(F.concat_ws("\0", *values), 256)


def hash_bucket(digest: Column, buckets: int = PPM, offset: int = 0) -> Column:
    """Eight digest bytes from `offset` as an unsigned big-endian number, modulo buckets."""
    number = F.conv(F.substring(digest, 2 * offset + 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % buckets).cast("long")


#: Seconds from year 1, from which windows are counted, to 1970.
YEAR_ONE = 62_135_596_800


def window_start(unix: Column, seconds: int) -> Column:
    """Start of the tumbling window a time (seconds from 1970) is in; windows are aligned to the beginning of year 1."""
    since = unix + YEAR_ONE
    return (since - F.pmod(since, F.lit(seconds)) - YEAR_ONE).cast("long")


def unix_seconds(at: str) -> Column:
    """Seconds from 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{at}`)").cast("long")


def backoff_seconds(attempt: Column, most: int) -> Column:
    return F.least(F.pow(F.lit(2), attempt - 1), F.lit(most)).cast("long")


RISKS = ("low", "medium", "high", "critical")


def risk_ordinal(risk: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(RISKS):
        out = F.when(risk == name, i + 1).otherwise(out)
    return out
