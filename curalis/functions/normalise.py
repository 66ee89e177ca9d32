"""Canonical names, buckets, paths and scenarios as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of generators, real sources and families, and architectures known to be diffusion models.
GENERATOR_ALIASES = {
    "stablediffusionv14": "sd14",
    "stablediffusion14": "sd14",
    "stablediffusionv15": "sd15",
    "stablediffusion15": "sd15",
    "vqdiffusion": "vqdm",
}
REAL_SOURCE_ALIASES = {"na": "unknown", "laion5b": "laion", "celebhq": "celebahq"}
FAMILY_ALIASES = {"diffusionbased": "diffusion", "ganbased": "gan", "otherbased": "other"}
DIFFUSION_FAMILIES = ("latdiff", "pixdiff")
DIFFUSION_ARCHITECTURES = (
    "adm", "ddim", "ddpm", "fluxschnell", "glide", "imagen", "kandinsky22", "latdiff",
    "pixartsigma", "pixdiff", "sd14", "sd15", "sdxl", "vqdm", "wuerstchen", "wukong",
)
# Words that may follow a generator's name as its version, and the operations of composed scenarios.
VERSION_SUFFIXES = ("v", "base", "large", "small", "xl")
COMPOSED_OPERATIONS = {
    "combo_social_resize_0.5_jpeg_70": ["resize_0.5", "jpeg_70"],
    "combo_repost_jpeg_90_resize_0.5_jpeg_70": ["jpeg_90", "resize_0.5", "jpeg_70"],
    "combo_crop_0.80_resize_0.5_jpeg_70": ["center_crop_0.80", "resize_0.5", "jpeg_70"],
    "combo_blur_1.0_resize_0.5_jpeg_50": ["blur_1.0", "resize_0.5", "jpeg_50"],
    "combo_edit_color_0.20_noise_0.02_jpeg_70": ["color_jitter_0.20", "noise_0.02", "jpeg_70"],
    "combo_stress_crop_0.80_blur_1.0_resize_0.25_jpeg_30": ["center_crop_0.80", "blur_1.0", "resize_0.25", "jpeg_30"],
}


def compact(c: Column) -> Column:
    """Lower case, letters and digits only; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]", "")


def look_up(c: Column, table: dict[str, str]) -> Column:
    """The table's value, else the column itself."""
    if not table:
        return c
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), c), c)


def canonical_generator(c: Column, aliases: dict[str, str] | None = None) -> Column:
    return look_up(compact(c), GENERATOR_ALIASES if aliases is None else aliases)


def matches_alias(c: Column, alias: str, aliases: dict[str, str] | None = None) -> Column:
    """The same generator, or the alias followed by a version: a digit or one of a few words."""
    name, wanted = canonical_generator(c, aliases), canonical_generator(F.lit(alias), aliases)
    rest = F.substr(name, F.length(wanted) + 1)
    version = rest.rlike("^[0-9]")
    for suffix in VERSION_SUFFIXES:
        version |= F.startswith(rest, F.lit(suffix))
    return (name == wanted) | (F.startswith(name, wanted) & version)


def held_out(columns: list[Column], names: list[str]) -> Column:
    """Whether any column names a held-out generator."""
    out = F.lit(False)
    for c in columns:
        for alias in names:
            out |= matches_alias(c, alias)
    return out


def group_name(c: Column, field: str) -> Column:
    """Reporting name of a group; empty for null or blank."""
    raw = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    if field == "source_dataset":
        return F.translate(F.lower(raw), "- ", "__")
    table = {"real_source": REAL_SOURCE_ALIASES, "generator_family": FAMILY_ALIASES}.get(field, {})
    return look_up(compact(raw), table)


def generator_family(family: Column, architecture: Column) -> Column:
    """One family for the diffusion kinds; a missing family is inferred from the architecture."""
    f = group_name(family, "generator_family")
    return (F.when(f.isin(*DIFFUSION_FAMILIES), "diffusion")
            .when(~f.isin("", "unknown"), f)
            .when(group_name(architecture, "architecture").isin(*DIFFUSION_ARCHITECTURES), "diffusion")
            .otherwise("unknown"))


def encoding_density(size: Column, width: Column, height: Column) -> Column:
    return size.cast("double") / F.greatest(F.lit(1), width * height)


def cut(c: Column, edges: list, names: list[str]) -> Column:
    """The name of the first edge that the value is under, else the last name."""
    out = F.when(c < edges[0], names[0])
    for e, n in zip(edges[1:], names[1:-1], strict=True):
        out = out.when(c < e, n)
    return out.otherwise(names[-1])


# The cut points and names of the buckets below are fixed values.
def nuisance_buckets(width: Column, height: Column, kind: Column, size: Column) -> dict[str, Column]:
    """Buckets of technical metadata that a label should not depend on."""
    ratio = width.cast("double") / F.greatest(F.lit(1), height)
    k = F.lower(kind)
    return {
        "resolution_bucket": cut(F.least(width, height), [192, 256, 384, 512, 768], ["lt192", "192_255", "256_383", "384_511", "512_767", "ge768"]),
        "aspect_bucket": F.when(ratio < 0.8, "portrait").when(ratio > 1.25, "landscape").otherwise("squareish"),
        "format_bucket": F.when(k.isin("jpg", "jpeg"), "jpeg").when(k.isin("png", "webp"), k).otherwise("other"),
        "encoding_density_bucket": cut(encoding_density(size, width, height), [0.5, 1.5], ["low", "medium", "high"]),
    }


def split_name(c: Column, known: tuple[str, ...] = ("train", "val", "test")) -> Column:
    """``validation`` is ``val``; null for names that are not known, so that they can be set apart."""
    name = F.when(c == "validation", "val").otherwise(c)
    return F.when(name.isin(*known), name)


def safe_path(path: Column) -> Column:
    """A relative path without ``./`` before it; null for empty, absolute or upward paths."""
    p = F.regexp_replace(path, r"^(\./)+", "")
    return F.when((p != "") & ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), ".."), p)


def first_of(*columns: Column, default: str) -> Column:
    """First value that is neither null nor blank, else the default."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns], F.lit(default))


def scenario_kind(c: Column) -> Column:
    return F.when(c == "clean", "clean").when(F.startswith(c, F.lit("combo_")), "composed").otherwise("single")


def scenario_operations(c: Column) -> Column:
    """The operations of a scenario in order: none for clean, its list for a composed one, else itself."""
    table = F.create_map(*chain(*[(F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in COMPOSED_OPERATIONS.items()]))
    return F.when(c == "clean", F.array().cast("array<string>")).otherwise(F.coalesce(F.element_at(table, c), F.array(c)))


def calibrated(logit: Column, coefficient, intercept) -> Column:
    return 1 / (1 + F.exp(-(F.lit(coefficient) * logit + F.lit(intercept))))
