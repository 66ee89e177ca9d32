"""Statistics and deterministic transformations of array columns; grids are square and row-major."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalis.functions import identity as H


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def std(v: Column) -> Column:
    both = F.struct(v.alias("v"), mean(v).alias("m"))
    return H.let(both, lambda p: F.sqrt(F.aggregate(p["v"], F.lit(0.0), lambda s, x: s + (x - p["m"]) * (x - p["m"])) / F.size(p["v"])))


def quantile(v: Column, q: float) -> Column:
    """Linear interpolation between the sorted values."""
    s, at = F.array_sort(v), (F.size(v) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.element_at(s, low + 1).cast("double"), F.element_at(s, F.least(low + 2, F.size(v))).cast("double")
    return a + (b - a) * (at - low)


def histogram(v: Column, low: float, high: float, bins: int) -> Column:
    """Counts per equal bin; values outside go to the end bins."""
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x.cast("double") - low) / ((high - low) / bins)).cast("int")))
    return H.let(F.transform(v, place), lambda places: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(places, lambda p: p == b))))


def entropy(counts: Column) -> Column:
    """Shannon entropy of counts, in bits."""
    both = lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0), lambda s, x: s + x).alias("n"))
    return H.let(H.let(counts, both), lambda p: F.aggregate(p["c"], F.lit(0.0), lambda s, x: s - F.when(x > 0, x / p["n"] * F.log2(x / p["n"])).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    both = lambda w: F.struct(w.alias("v"), F.sqrt(dot(w, w)).alias("n"))
    return H.let(H.let(v, both), lambda p: F.transform(p["v"], lambda x: x / p["n"]))


def softmax(v: Column) -> Column:
    e = H.let(v, lambda w: F.transform(w, lambda x: F.exp(x - F.array_max(w))))
    return H.let(e, lambda w: F.transform(w, lambda x: x / total(w)))


def gated_fusion(layers: Column, gate: list[float], bias: list[float]) -> Column:
    """Weights over layers (softmax of gate times layer plus bias) and their normalised weighted sum."""
    g = F.array(*[F.lit(float(x)) for x in gate])
    b = F.array(*[F.lit(float(x)) for x in bias])
    w = softmax(F.zip_with(F.transform(layers, lambda v: dot(v, g)), b, lambda x, y: x + y))
    parts = F.zip_with(layers, w, lambda v, k: F.transform(v, lambda x: x * k))
    zero = F.transform(F.element_at(layers, 1), lambda x: F.lit(0.0))
    return normalised(F.aggregate(parts, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)))


def neighbours(grid: Column, side: int, kernel: list[list[float]]) -> Column:
    """Convolution with a 3 by 3 kernel; the border is mirrored without repeating the edge."""
    mirror = lambda i: F.when(i < 0, -i).when(i >= side, 2 * side - 2 - i).otherwise(i)

    def cell(g: Column, i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), i % side
        out = F.lit(0.0)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                if kernel[dr + 1][dc + 1]:
                    out += F.lit(float(kernel[dr + 1][dc + 1])) * F.element_at(g, mirror(r + dr) * side + mirror(c + dc) + 1)
        return out

    return H.let(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: cell(g, i)))


def windowed(grid: Column, side: int, height: int, width: int, cell, down: int = 1, right: int = 1, top: int = 0, left: int = 0) -> Column:
    """``cell(at)`` for ``height`` by ``width`` places of a grid, ``down`` and ``right`` apart; ``at(r, c)`` is the value that far from the place."""
    def one(g: Column, i: Column) -> Column:
        row, column = F.floor(i / width).cast("int") * down + top, i % width * right + left
        return cell(lambda r, c: F.element_at(g, (row + r) * side + column + c + 1).cast("double"))

    return H.let(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: one(g, i)))


def gradient(grid: Column, side: int) -> Column:
    """Lengths of the differences to the right and downwards, where both exist."""
    return windowed(grid, side, side - 1, side - 1, lambda at: F.sqrt((at(0, 1) - at(0, 0)) * (at(0, 1) - at(0, 0)) + (at(1, 0) - at(0, 0)) * (at(1, 0) - at(0, 0))))


def laplacian(grid: Column, side: int) -> Column:
    """The four neighbours less four times the cell, without the border."""
    return windowed(grid, side, side - 2, side - 2, lambda at: at(0, 1) + at(2, 1) + at(1, 0) + at(1, 2) - 4 * at(1, 1))


def steps(grid: Column, side: int, vertical: bool = False) -> Column:
    """Absolute differences of cells side by side, or one above the other."""
    r, c = (1, 0) if vertical else (0, 1)
    return windowed(grid, side, side - r, side - c, lambda at: F.abs(at(r, c) - at(0, 0)))


def block_ratio(grid: Column, side: int, block: int) -> Column:
    """Mean difference over the borders of blocks against the mean difference of all neighbours; 0 without such borders."""
    n = (side - 1) // block
    if not n:
        return F.lit(0.0)
    over = lambda vertical: windowed(grid, side, n if vertical else side, side if vertical else n, lambda at: F.abs(at(0, 0) - (at(-1, 0) if vertical else at(0, -1))),
                                     *((block, 1, block, 0) if vertical else (1, block, 0, block)))
    return (mean(over(False)) + mean(over(True))) / F.greatest(F.lit(1e-8), mean(steps(grid, side)) + mean(steps(grid, side, True)))


def residual_moments(v: Column) -> Column:
    """Mean of absolute values, deviation, root of the mean square, fourth root of the mean fourth power."""
    power = lambda w, k: F.aggregate(w, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(float(k)))) / F.size(w)
    return H.let(v, lambda w: F.struct(power(w, 1).alias("mean_abs"), std(w).alias("std"), F.sqrt(power(w, 2)).alias("rms"), F.pow(F.greatest(power(w, 4), F.lit(1e-12)), F.lit(0.25)).alias("fourth")))


def fourier_matrices(side: int) -> tuple[list[list[float]], list[list[float]]]:
    """Cosines and sines of the discrete Fourier transform."""
    angle = lambda u, x: 2 * math.pi * u * x / side
    return ([[math.cos(angle(u, x)) for x in range(side)] for u in range(side)], [[math.sin(angle(u, x)) for x in range(side)] for u in range(side)])


def spectrum(grid: Column, side: int) -> Column:
    """Power of the two-dimensional Fourier transform of a grid less its mean, row-major from frequency 0."""
    c, s = fourier_matrices(side)
    centred = H.let(grid, lambda g: H.let(F.struct(g.alias("g"), mean(g).alias("m")), lambda p: F.transform(p["g"], lambda x: x.cast("double") - p["m"])))
    parts = lambda g: F.struct(*[H.sandwich(a, g, b, side).alias(n) for n, a, b in (("cc", c, c), ("ss", s, s), ("cs", c, s), ("sc", s, c))])
    power = lambda p: F.zip_with(F.zip_with(p["cc"], p["ss"], lambda x, y: (x - y) * (x - y)), F.zip_with(p["cs"], p["sc"], lambda x, y: (x + y) * (x + y)), lambda x, y: x + y)
    return H.let(H.let(centred, parts), power)


def radial_bands(side: int, cuts: tuple[float, ...]) -> list[int]:
    """Band of each cell of a spectrum by its distance from the middle, zero frequency moved there, as a part of the largest distance."""
    middle = (side - 1) / 2
    radius = [math.hypot((r + side // 2) % side - middle, (c + side // 2) % side - middle) for r in range(side) for c in range(side)]
    return [sum(x / max(1.0, max(radius)) >= cut for cut in cuts) for x in radius]


def band_shares(power: Column, bands: list[int]) -> Column:
    """Share of the whole power in each band."""
    at = F.array(*[F.lit(b) for b in bands])
    one = lambda p, k: total(F.zip_with(p, at, lambda x, b: F.when(b == k, x).otherwise(0.0))) / (total(p) + 1e-12)
    return H.let(power, lambda p: F.array(*[one(p, k) for k in range(max(bands) + 1)]))


def erf(x: Column) -> Column:
    """The error function, by a series without cancelling terms; beyond 6 it is 1."""
    def series(y: Column) -> Column:
        acc = F.struct(y.alias("term"), y.alias("sum"))
        step = lambda a, n: F.struct((a["term"] * 2 * y * y / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * y * y / (2 * n + 1)).alias("sum"))
        return 2 / math.sqrt(math.pi) * F.exp(-y * y) * F.aggregate(F.sequence(F.lit(1), F.lit(120)), acc, step)["sum"]

    return H.let(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), x.cast("double"))), series)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    both = F.struct(v.alias("v"), mean(v).alias("m"), std(v).alias("s"))
    return H.let(both, lambda p: F.transform(p["v"], lambda x: (x - p["m"]) / F.sqrt(p["s"] * p["s"] + epsilon)))


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """One output for each row of ``weights``."""
    return H.let(v, lambda w: F.zip_with(F.transform(H.matrix_column(weights), lambda row: dot(w, row)), F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x + b))


def head(v: Column, first: list[list[float]], first_bias: list[float], second: list[float], second_bias: float) -> Column:
    """A score: normalised vector, linear layer, GELU, linear output."""
    hidden = F.transform(linear(layer_norm(F.transform(v, lambda x: x.cast("double"))), first, first_bias), gelu)
    return dot(hidden, F.array(*[F.lit(float(x)) for x in second])) + second_bias


def gaussian_matrix(side: int, sigma: float) -> list[list[float]]:
    """Rows of a normalised smoothing kernel cut at three deviations; the border is extended by its edge."""
    reach = max(1, math.ceil(3 * sigma))
    weights = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)}
    whole = sum(weights.values())
    out = [[0.0] * side for _ in range(side)]
    for i in range(side):
        for d, w in weights.items():
            out[i][min(side - 1, max(0, i + d))] += w / whole
    return out


def resize_matrix(source: int, target: int, first: int = 0, whole: int | None = None) -> list[list[float]]:
    """Linear interpolation from ``source`` samples (of ``whole``, from ``first`` on) to ``target``."""
    out = []
    for i in range(target):
        x = min(source - 1.0, max(0.0, (i + 0.5) * source / target - 0.5))
        low = int(x)
        row = [0.0] * (whole or source)
        row[first + low] += 1 - (x - low)
        row[first + min(source - 1, low + 1)] += x - low
        out.append(row)
    return out


def product(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(x * y for x, y in zip(r, c, strict=True)) for c in zip(*b, strict=True)] for r in a]


def down_up_matrix(side: int, scale: float) -> list[list[float]]:
    small = max(1, round(side * scale))
    return product(resize_matrix(small, side), resize_matrix(side, small))


def crop_matrix(side: int, fraction: float) -> list[list[float]]:
    inner = max(1, round(side * fraction))
    return resize_matrix(inner, side, (side - inner) // 2, side)


def apply_matrix(grid: Column, matrix: list[list[float]], side: int) -> Column:
    return H.sandwich(matrix, grid, matrix, side)


def quantised(grid: Column, side: int, step: float) -> Column:
    """Cosine coefficients rounded to multiples of ``step``, transformed back: the loss of a lossy codec."""
    c = H.cosine_matrix(side)
    back = [list(r) for r in zip(*c, strict=True)]
    coarse = F.transform(H.sandwich(c, grid, c, side), lambda x: F.floor(x / step + 0.5) * step)
    return H.sandwich(back, coarse, back, side)


def noisy(grid: Column, identity: Column, sigma: float) -> Column:
    """Additive normal noise by Box-Muller from hashes of identity and place, clipped to [0, 1] and rounded to 8 bits."""
    def one(x: Column, i: Column) -> Column:
        u = H.uniform(F.sha2(F.concat_ws("|", identity, i.cast("string"), F.lit("a")), 256))
        w = H.uniform(F.sha2(F.concat_ws("|", identity, i.cast("string"), F.lit("b")), 256))
        return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w))) * 255) / 255

    return F.transform(grid, one)


def jittered(grid: Column, identity: Column, amount: float) -> Column:
    """Brightness and contrast changed by hashed factors within ``amount``, in hashed order, clipped to [0, 1]."""
    u = lambda s: H.uniform(F.sha2(F.concat_ws("|", identity, F.lit(s)), 256))
    b, k = 1 - amount + 2 * amount * u("brightness"), 1 - amount + 2 * amount * u("contrast")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    bright = lambda v: F.transform(v, lambda x: clip(x * b))

    def contrast(v: Column) -> Column:
        both = lambda w: F.struct(w.alias("v"), mean(w).alias("m"))
        return H.let(H.let(v, both), lambda p: F.transform(p["v"], lambda x: clip((x - p["m"]) * k + p["m"])))

    return F.when(u("order") < 0.5, contrast(bright(grid))).otherwise(bright(contrast(grid)))


def weighted_picks(identity: Column, weights: dict[str, float], count: Column) -> Column:
    """``count`` of the names without replacement, by the least ``-ln(u) / weight``."""
    race = F.array_sort(F.array(*[F.struct((-F.log(H.uniform(F.sha2(F.concat_ws("|", identity, F.lit(k)), 256))) / w).alias("t"), F.lit(k).alias("k")) for k, w in weights.items()]))
    return F.transform(F.slice(race, 1, count), lambda x: x["k"])


# Probabilities, weights and ranges of the augmentation plan.
PLAN = {
    "standardise": 0.75, "modes": {"resize": 0.30, "codec": 0.30, "resize_codec": 0.40}, "scale": (0.75, 1.0), "codecs": {"jpeg": 0.80, "webp": 0.20}, "quality": (85, 100),
    "wide": (0.90, 1.0), "close": (0.50, 0.90), "filters": ("bilinear", "bicubic", "lanczos"), "none": 0.25, "one": 0.50,
    "operations": {"jpeg": 1.0, "blur": 1.0, "resize": 1.0, "noise": 1.0, "colour": 1.0, "crop": 1.0, "double_jpeg": 0.08, "webp": 0.05},
    "levels": {"jpeg": (30, 95), "blur": (0.1, 2.0), "resize": (0.25, 1.0), "noise": (0.0, 0.10), "colour": (-0.20, 0.20), "crop": (0.70, 1.0), "double_jpeg": (30, 95), "webp": (30, 95)},
}
#: Operations whose level is a whole number, and those that draw a second level.
WHOLE_LEVELS, SECOND_LEVELS = ("jpeg", "double_jpeg", "webp"), ("double_jpeg", "colour")


def augmentation_plan(identity: Column, width: Column, height: Column, plan: dict = PLAN) -> dict[str, Column]:
    """Everything that an augmented view of a record draws, as named columns of hash-seeded numbers: no draw depends on another row.

    Whether and how to standardise (mode, scale, codec, quality), crops of the wide and the close view (side by half-even rounding of a
    share of the shorter edge, then left and top), the filter, the number of operations, and for each of the two an operation without
    replacement with its one or two levels. What a plan does not use is null.
    """
    u = lambda name: H.uniform(F.sha2(F.concat_ws("|", identity, F.lit(name)), 256))
    between = lambda name, low, high: F.lit(float(low)) + u(name) * float(high - low)
    whole = lambda name, low, high: (F.lit(low) + F.floor(u(name) * (high - low + 1))).cast("long")
    one_of = lambda name, weights: weighted_picks(F.concat_ws("|", identity, F.lit(name)), weights, F.lit(1))[0]
    out: dict[str, Column] = {}
    out["standardised"] = u("standardise") < plan["standardise"]
    out["mode"] = F.when(out["standardised"], one_of("mode", plan["modes"]))
    out["scale"] = F.when(out["mode"].contains("resize"), between("scale", *plan["scale"]))
    out["codec"] = F.when(out["mode"].contains("codec"), one_of("codec", plan["codecs"]))
    out["quality"] = F.when(out["mode"].contains("codec"), whole("quality", *plan["quality"]))
    for view in ("wide", "close"):
        side = F.greatest(F.lit(1), F.bround(F.least(width, height) * between(view, *plan[view]), 0).cast("long"))
        spot = lambda name, edge, side=side: F.floor(u(name) * (F.greatest(F.lit(0), edge - side) + 1)).cast("long")
        out |= {f"{view}_side": side, f"{view}_left": spot(f"{view}-left", width), f"{view}_top": spot(f"{view}-top", height)}
    out["filter"] = one_of("filter", dict.fromkeys(plan["filters"], 1.0))
    count = F.when(u("count") < plan["none"], 0).when(u("count") < plan["none"] + plan["one"], 1).otherwise(2)
    out["operations"] = count
    picks = weighted_picks(F.concat_ws("|", identity, F.lit("operation")), plan["operations"], F.lit(2))
    for k in (1, 2):
        op = F.when(count >= k, picks[k - 1])
        out[f"operation_{k}"] = op
        for n, names in (("a", tuple(plan["operations"])), ("b", SECOND_LEVELS)):
            value = F.lit(None).cast("double")
            for name in names:
                draw = whole if name in WHOLE_LEVELS else between
                value = F.when(op == name, draw(f"level-{k}{n}", *plan["levels"][name]).cast("double")).otherwise(value)
            out[f"level_{k}{n}"] = value
    return out


def folded(grid: Column, operations: list) -> Column:
    """The operations applied one after another, each a function of a grid."""
    for f in operations:
        grid = H.let(grid, f)
    return grid
