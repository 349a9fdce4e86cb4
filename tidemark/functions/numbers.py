"""Column expressions over numbers. All are built-in functions and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def parse_double(x: Column | str, none_word: bool = False) -> Column:
    """A string as a number: what isn't one (Spark alone would take 1d) is null; with none_word, so is the literal None. Digits may be grouped by underscores."""
    s = col(x).cast("string")
    number = F.when(s.rlike(_NUMBER), F.expr("try_cast(1 as double)") * F.replace(F.trim(s), F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(s == "None", None).otherwise(number) if none_word else number


def parse_int(x: Column | str) -> Column:
    """A string of digits as an integer; anything else, 200.0 too, is null."""
    s = col(x).cast("string")
    return F.when(s.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(s).try_cast("int"))


def clamp(x: Column | str, low, high) -> Column:
    return F.least(F.greatest(col(x), lit(low)), lit(high))


def shifted_sigmoid(x: Column | str, k: float = 5.0, centre: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-F.lit(float(k)) * (col(x) - F.lit(centre))))


def linear_map(x: Column, low: Column, high: Column, to_low, to_high) -> Column:
    """x from [low, high] to [to_low, to_high]; where that range is a point, the middle of the target."""
    a, b = lit(to_low), lit(to_high)
    return F.when(F.abs(high - low) < 1e-12, (a + b) / 2).otherwise(a + (x - low) * (b - a) / F.nullif(high - low, F.lit(0.0)))


def _hours(age: Column) -> Column:
    return F.when(age > 0, age).otherwise(F.lit(1 / 12))


def capacity(score: Column, multiplier: float = 1.5) -> Column:
    """Carrying capacity of a growth curve that begins at 1 and has reached score."""
    n = F.greatest(score, F.lit(0.0))
    return F.greatest(n * multiplier + 1, n + 1, F.lit(2.0))


def logistic_rate(score: Column, age: Column, multiplier: float = 1.5) -> Column:
    """Rate of the logistic curve from 1 through (age, score), never negative."""
    n, top = F.greatest(score, F.lit(0.0)), capacity(score, multiplier)
    left = clamp((top - n) / F.greatest(n * (top - 1), F.lit(1e-6)), 1e-6, 1e6)
    return F.greatest(-F.ln(left) / _hours(age), F.lit(0.0))


def logistic_at(top: Column, rate: Column, hours: Column) -> Column:
    return top / (1 + (top - 1) * F.exp(-rate * hours))


def gompertz_rate(score: Column, age: Column, multiplier: float = 1.5) -> Column:
    """Rate of the Gompertz curve from 1 through (age, score), never negative."""
    n, top = F.greatest(score, F.lit(0.0)), capacity(score, multiplier)
    left = clamp(-F.ln(clamp(n / top, 1e-9, 1 - 1e-6)) / F.ln(top), 1e-6, 0.999999)
    return F.greatest(-F.ln(left) / _hours(age), F.lit(0.0))


def gompertz_at(top: Column, rate: Column, hours: Column) -> Column:
    return top * F.exp(-F.ln(top) * F.exp(-rate * hours))


def branching_ratio(score: Column, comments: Column) -> Column:
    """Share of comments in all engagement, from 0 to 0.95: the self-excitation of a Hawkes process."""
    return clamp(comments / F.greatest(score + comments, F.lit(1e-6)), 0.0, 0.95)


def hawkes_base(score: Column, age: Column, ratio: Column) -> Column:
    return F.greatest(score / _hours(age) * (1 - ratio), F.lit(0.0))


def hawkes_expected(base: Column, ratio: Column, hours: Column | float) -> Column:
    return base * hours / F.greatest(1 - ratio, F.lit(1e-6))


def early_fraction(value: Column, score: Column) -> Column:
    """value as a share of score, from 0 to 1.5; 0 without a positive score."""
    return F.when(score > 0, clamp(value / F.nullif(score, F.lit(0.0)), 0.0, 1.5)).otherwise(F.lit(0.0))


def infection_probability(content: Column, cred: Column, base: float, coefficient: float, noise: Column) -> Column:
    return clamp(F.lit(base) + F.lit(coefficient) * content * (1 - cred) + noise, 0.0, 1.0)


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(bits))


def softmax(logits: Column | str) -> Column:
    """Softmax of an array of numbers, shifted by its maximum."""
    x = col(logits)
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where one vector is zero."""
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def js_divergence(p: Column | str, q: Column | str) -> Column:
    """Mean of KL(average, p) and KL(average, q): the arguments are the other way round than in the textbook form."""
    mean = F.zip_with(col(p), col(q), lambda x, y: (x + y) / 2)

    def kl(x):
        return F.aggregate(F.zip_with(mean, col(x), lambda m, y: m * (F.ln(m) - F.ln(y))), F.lit(0.0), lambda s, v: s + v)

    return (kl(p) + kl(q)) / 2


def cosine_rate(step: Column, steps: float, base: float, end: float = 0.0) -> Column:
    return F.lit(end) + (F.lit(base) - F.lit(end)) * (F.cos(F.lit(3.141592653589793) * step / F.lit(float(steps))) + 1) / 2


def step_rate(step: Column, steps: list[float], rates: list[float]) -> Column:
    """The rate of the last of `steps` that has begun; steps ascend and begin at 0."""
    out = F.lit(rates[0])
    for at, rate in zip(steps[1:], rates[1:], strict=True):
        out = F.when(step >= at, F.lit(rate)).otherwise(out)
    return out


def linear_decay(step: Column, steps: float, start: float, base: float) -> Column:
    """base up to step `start`, then falling in a line to 0 at `steps`."""
    return F.when(step <= start, F.lit(base)).otherwise(F.greatest(F.lit(base) * (1 - (step - start) / F.lit(float(steps - start))), F.lit(0.0)))
