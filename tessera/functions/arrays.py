"""Functions of token rows: arrays of numbers with 0/1 masks, one array per response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(a: Column, length: int, value, left: bool = False) -> Column:
    """To a length, never shorter."""
    more = F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(a)))
    return F.concat(more, a) if left else F.concat(a, more)


def truncate(a: Column, length: int, how: str = "error") -> Column:
    """Keep the tail ('left'), the head ('right'), or raise."""
    if how == "left":
        return F.when(F.size(a) > length, F.slice(a, -length, length)).otherwise(a)
    if how == "right":
        return F.slice(a, 1, length)
    return F.when(F.size(a) > length, F.raise_error(F.lit(f"longer than {length}")).cast("array<int>")).otherwise(a)


def unpad(a: Column, mask: Column) -> Column:
    """Drops left padding."""
    n = total(mask).cast("int")
    return F.when(n > 0, F.slice(a, F.size(a) - n + 1, n)).otherwise(F.slice(a, 1, 0))


def loss_mask(mask: Column, prompt: Column) -> Column:
    """The mask with the prompt but its last token, and the last position, set to 0."""
    last = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    return F.transform(mask, lambda x, i: F.when((i < prompt - 1) | (i == F.least(last, F.size(mask)) - 1), 0).otherwise(x))


def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def entropy(logits: Column) -> Column:
    z = log_sum_exp(logits)
    return z - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x)


def log_prob(logits: Column, label: Column) -> Column:
    return F.get(logits, label) - log_sum_exp(logits)


def position_ids(mask: Column) -> Column:
    """Running sum of the mask minus one, not below 0."""
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(mask, state, lambda s, m: F.struct(F.concat(s["out"], F.array(F.greatest(F.lit(0), s["n"] + m - 1))).alias("out"), (s["n"] + m).alias("n")))["out"]


def response_mask(tokens: Column, eos: Column) -> Column:
    """1 up to and with the first end token."""
    first = F.array_position(F.transform(tokens, lambda t: t.isin(*eos) if isinstance(eos, (list, tuple)) else t == eos), True)
    return F.transform(tokens, lambda _, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def _backwards(a: Column, step) -> Column:
    """Scan from the end: step(carry, element) -> (value, carry)."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("carry"))

    def fold(s: Column, x: Column) -> Column:
        value, carry = step(s["carry"], x)
        return F.struct(F.array_prepend(s["out"], value).alias("out"), carry.alias("carry"))

    return F.aggregate(F.reverse(a), start, fold)["out"]


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening; the value after the end is 0."""
    after = F.concat(F.slice(values, 2, 10**9), F.array(F.lit(0.0)))
    deltas = F.zip_with(F.zip_with(rewards, after, lambda r, v: r + gamma * v), values, lambda x, v: x - v)
    return _backwards(deltas, lambda c, d: (d + gamma * lam * c, d + gamma * lam * c))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Returns whose carry the mask clears."""
    pairs = F.zip_with(rewards, mask, lambda r, m: F.struct(r.alias("r"), m.alias("m")))
    return _backwards(pairs, lambda c, x: (x["r"] + gamma * c, (x["r"] + gamma * c) * x["m"]))


def reverse_cumsum(a: Column) -> Column:
    return _backwards(a, lambda c, x: (x + c, x + c))


def process_reward(q: Column, lam: float, token_mode: bool = False) -> Column:
    """Lambda returns from the end of a row of token values; token mode leaves the last value out."""
    used = F.transform(q, lambda x, i: F.when(i == F.size(q) - 1, 0.0).otherwise(x)) if token_mode else q
    return _backwards(used, lambda c, x: (x + lam * c, x + lam * c))


def kl(logp: Column, ref: Column, kind: str = "kl") -> Column:
    """Per token: 'kl', 'abs', 'mse' or 'low_var_kl'."""
    forms = {
        "kl": lambda a, b: a - b,
        "abs": lambda a, b: F.abs(a - b),
        "mse": lambda a, b: 0.5 * (a - b) * (a - b),
        "low_var_kl": lambda a, b: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(b - a) - (b - a) - 1)),
    }
    return F.zip_with(logp, ref, forms[kind])


def masked_mean(a: Column, mask: Column) -> Column:
    return total(F.zip_with(a, mask, lambda x, m: x * m)) / (total(mask) + 1e-8)


def kl_reward(scores: Column, kld: Column, mask: Column, beta: float) -> Column:
    return F.zip_with(scores, F.zip_with(kld, mask, lambda k, m: beta * k * m), lambda s, p: s - p)


def kl_coefficients(currents: Column, horizon: float, steps: Column, start: float, target: float) -> Column:
    """An adaptive coefficient after each of a row of measured divergences."""
    state = F.struct(F.array().cast("array<double>").alias("out"), F.lit(start).alias("b"))

    def fold(s: Column, x: Column) -> Column:
        error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), x / target - 1))
        b = s["b"] * (1 + error * steps / horizon)
        return F.struct(F.concat(s["out"], F.array(b)).alias("out"), b.alias("b"))

    return F.aggregate(currents, state, fold)["out"]


def policy_loss(old: Column, new: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Struct per token: dual-clip loss, whether it is clipped above, whether below."""
    ratio = F.exp(new - old)
    plain = -advantage * ratio
    bounded = -advantage * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    worst = F.greatest(plain, bounded)
    floor = -advantage * dual
    loss = F.when(advantage < 0, F.least(floor, worst)).otherwise(worst)
    return F.struct(loss.alias("loss"), (bounded > plain).cast("double").alias("clipped"), ((worst > floor) & (advantage < 0)).cast("double").alias("clipped_low"), (old - new).alias("kl"))


def value_loss(predicted: Column, returns: Column, old: Column, width: float) -> Column:
    """Struct per token: half the larger squared error, and whether clipping made it larger."""
    bounded = F.greatest(old - width, F.least(old + width, predicted))
    a, b = (predicted - returns) * (predicted - returns), (bounded - returns) * (bounded - returns)
    return F.struct((0.5 * F.greatest(a, b)).alias("loss"), (b > a).cast("double").alias("clipped"))


def dpo_loss(logit: Column, label: Column, beta: float) -> Column:
    """Binary cross-entropy of a scaled sum."""
    p = 1 / (1 + F.exp(-beta * logit))
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


def warmup(step: Column, steps: int) -> Column:
    return F.when(step < steps, step / float(max(1, steps))).otherwise(1.0)


def warmup_cosine(step: Column, warm: int, last: int, least: float = 0.0, cycles: float = 0.5) -> Column:
    progress = (step - warm) / float(max(1, last - warm))
    wave = F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793 * cycles * 2.0) * progress) * ((1 - least) * 0.5) + (1 + least) * 0.5)
    return F.when(step < warm, step / float(max(1, warm))).otherwise(wave)


def resized(width: Column, height: Column, most: int = 2048 * 2048, least: int = 512 * 512) -> Column:
    """Width and height scaled into bounds on their product."""
    down = F.sqrt(F.lit(float(most)) / (width * height))
    w = F.when(width * height > most, F.floor(width * down)).otherwise(width)
    h = F.when(width * height > most, F.floor(height * down)).otherwise(height)
    up = F.sqrt(F.lit(float(least)) / (w * h))
    return F.struct(F.when(w * h < least, F.floor(w * up)).otherwise(w).cast("int").alias("width"), F.when(w * h < least, F.floor(h * up)).otherwise(h).cast("int").alias("height"))


def flops(tokens: Column, squares: Column, parameters: float, head: int, heads: int, layers: int, seconds: Column) -> Column:
    """Tera-operations per second of a step: dense layers and attention."""
    return (6.0 * parameters * tokens + 12.0 * squares * head * heads * layers) / seconds / 1e12


def digit_sequence(first: Column, step: Column, count: int, modulus: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: (first + i * step) % modulus)


def random_left_mask(n: Column, key: Column, seed: int = 0) -> Column:
    """n ones of which a number of first ones, less than half of n, by a hash of seed and key, are 0."""
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 13), 16, 10).cast("long")
    left = F.pmod(hashed, F.greatest(F.floor(n / 2), F.lit(1)))
    return F.transform(F.array_repeat(F.lit(1), n), lambda _, i: (i >= left).cast("int"))
