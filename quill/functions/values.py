"""Column functions over numbers, dates, JSON and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a guarded cast takes as a number: digits with an optional fraction; no sign, no exponent.
PLAIN_NUMBER = r"^[0-9]+(\.[0-9]+)?$"
#: Lower bounds of the risk bands, highest first.
RISK_BANDS = ((0.9, "CRITICAL"), (0.6, "HIGH"), (0.3, "MEDIUM"))


def guarded_decimal(text: Column) -> Column:
    """Plain non-negative decimals as DECIMAL(38,6); anything else is 0."""
    return F.when(text.rlike(PLAIN_NUMBER), text.cast("decimal(38,6)")).otherwise(F.lit(0).cast("decimal(38,6)"))


def json_or(text: Column, path: str, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.get_json_object(text, path), F.lit("")), F.lit(default))


def json_int(text: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(text, path).try_cast("int"), F.lit(0))


def band(risk: Column) -> Column:
    out = None
    for low, name in RISK_BANDS:
        out = F.when(risk >= low, name) if out is None else out.when(risk >= low, name)
    return out.otherwise("LOW")


def ratio(part: Column, whole: Column, scale: int = 6) -> Column:
    """Quotient rounded half up; 0 where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") / whole.cast("double"), scale))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def whole_seconds(start: Column, stop: Column) -> Column:
    """Seconds between two timestamps, 0 if negative or unended."""
    micros = F.unix_micros(stop.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0), F.floor(micros / 1_000_000)), F.lit(0)).cast("long")


def age_points(days: Column, cap: int = 10) -> Column:
    return F.least(F.lit(cap), F.floor(days * 0.10).cast("int"))


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(300), F.pow(F.lit(2), F.least(F.lit(8), attempts - 1)).cast("int"))


def token_cost(tokens: Column, price: Column) -> Column:
    """Price is per million tokens; 8 digits, half up."""
    return F.round(tokens.cast("decimal(20,0)") * price.cast("decimal(16,8)") / F.lit(1_000_000).cast("decimal(10,0)"), 8)


def micros(cost: Column) -> Column:
    return F.ceil(F.greatest(cost, F.lit(0)) * 1_000_000).cast("long")


def iou(a: Column, b: Column) -> Column:
    """Of two boxes [x0, y0, x1, y1]; null where a box has no area."""
    side = lambda x, i: x[i + 2] - x[i]
    area = lambda x: side(x, 0) * side(x, 1)
    over = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.when((side(a, 0) > 0) & (side(a, 1) > 0) & (side(b, 0) > 0) & (side(b, 1) > 0), over / (area(a) + area(b) - over))


def unit_box(box: Column, width: Column, height: Column, flipped: bool = False) -> Column:
    """A box in page units scaled to [0, 1000], 5 digits; null where it does not lie in the page."""
    x = lambda i: F.round(box[i] * 1000 / width, 5)
    y = lambda i: F.round((height - box[i] if flipped else box[i]) * 1000 / height, 5)
    out = F.array(x(0), y(3) if flipped else y(1), x(2), y(1) if flipped else y(3))
    good = (F.size(box) == 4) & (width > 0) & (height > 0) & (out[0] >= 0) & (out[1] >= 0) & (out[2] <= 1000) & (out[3] <= 1000) & (out[0] < out[2]) & (out[1] < out[3])
    return F.when(good, out)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hexadecimal."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    return F.bit_count(number(a).bitwiseXOR(number(b)))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """First 8 hexadecimal digits of the SHA-256, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def same_choice(selected: Column, correct: Column) -> Column:
    """Order is ignored; repeats and parts are wrong; nothing chosen equals nothing correct."""
    s = F.coalesce(selected, F.array().cast("array<string>"))
    return (F.array_sort(s) == F.array_sort(correct)) & (F.size(s) == F.size(F.array_distinct(s)))


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a share; null for no cases."""
    p = wins / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, (centre - spread) / scale), F.when(n > 0, (centre + spread) / scale)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of two discordant counts; 1 without any."""
    n, low = b + c, F.least(b, c)
    start = -n * F.log(F.lit(2.0))
    # the logarithm of C(n, k) / 2^n follows from that of k - 1
    step = lambda acc, k: F.struct((acc["log"] + F.log((n - k + 1) / k)).alias("log"), (acc["sum"] + F.exp(acc["log"] + F.log((n - k + 1) / k))).alias("sum"))
    ks = F.when(low > 0, F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(ks, F.struct(start.alias("log"), F.exp(start).alias("sum")), step, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


#: By level the bounds of concepts, steps and score, whether the scenario is new, the answer stands in the text, and things are compared.
LEVELS = (
    ("L1", 1, 1, 0, 0, 1, 2, False, True, False),
    ("L2", 1, 2, 1, 1, 3, 4, False, False, False),
    ("L3", 1, 2, 1, 2, 5, 7, True, False, False),
    ("L4", 2, 4, 2, 3, 8, 10, True, False, True),
    ("L5", 3, 6, 3, 5, 11, 99, True, False, True),
)


def demand(concepts: Column, steps: Column, scenario: Column, comparison: Column) -> Column:
    """How much a question asks for: concepts, twice the steps, and one each for a new scenario and a comparison."""
    return concepts + 2 * steps + scenario.cast("int") + comparison.cast("int")


def level_faults(level: Column, concepts: Column, steps: Column, score: Column, scenario: Column, direct: Column, comparison: Column) -> Column:
    """Names of what a question's profile breaks of its level."""
    out = F.array().cast("array<string>")
    for name, k0, k1, r0, r1, s0, s1, new, there, compared in LEVELS:
        checks = {"concepts": concepts.between(k0, k1), "steps": steps.between(r0, r1), "score": score.between(s0, s1), "scenario": scenario == F.lit(new), "direct": direct == F.lit(there), "comparison": comparison == F.lit(compared)}
        out = F.when(level == name, F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in checks.items())))).otherwise(out)
    return out
