"""Column expressions: no UDFs, everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Marker and cell-type vocabularies of the cell tables.
MARKERS = ["DAPI", "Foxp3", "CD19", "CD68", "CD4", "CD3", "CD8", "SampleAF"]
CELL_TYPES = ["B cell", "CD4 T", "CD8 T", "Macrophage", "Other", "T cell", "Treg"]
COARSE_TYPES = {
    "CD4 T": "T",
    "CD8 T": "T",
    "Treg": "T",
    "T cell": "T",
    "B cell": "B",
    "Macrophage": "Myeloid",
    "Other": "Other",
}
POSITIVE_MARKERS = ["CD3", "CD4", "CD8", "Foxp3", "CD19", "CD68"]
COEXPRESSION_PAIRS = [
    ("CD3", "CD4"), ("CD3", "CD8"), ("CD3", "Foxp3"),
    ("CD19", "CD68"), ("CD68", "Foxp3"), ("CD4", "Foxp3"),
]
# Microns per pixel by objective magnification.
MICRONS_PER_PIXEL = {10: 1.0, 20: 0.5, 40: 0.25, 60: 0.1667}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and both infinities become NULL, so comparisons and moments skip them."""
    x = col(c).cast("double")
    inf = float("inf")
    return F.when(~F.isnan(x) & (x != F.lit(inf)) & (x != F.lit(-inf)), x)


def coerce_number(c: Column | str) -> Column:
    """Text or number to double; anything unreadable becomes NULL."""
    return finite(col(c).try_cast("double"))


def patch_id(cell_id: Column | str) -> Column:
    """The id without its last ``_`` part; an id without ``_`` is its own patch."""
    c = col(cell_id).cast("string")
    keep = F.length(c) - F.length(F.substring_index(c, "_", -1)) - 1
    return F.when(keep >= 0, F.substring(c, F.lit(1), keep)).otherwise(c)


def patch_part(pid: Column | str, which: int, pattern: str = r"^(\d+)_(\d+)$",
               stride: int | None = None) -> Column:
    """One integer of a patch id; NULL when the id does not match.  With
    ``stride`` the id holds grid indices and the pixel position is returned."""
    text = F.regexp_extract(col(pid), pattern, which)
    n = F.when(text != "", text).cast("bigint")
    return n if stride is None else n * F.lit(stride)


def coarse_type(c: Column | str, mapping: dict[str, str] | None = None) -> Column:
    """Fine cell type to its lineage; unknown names pass through."""
    c = col(c)
    table = F.create_map(*[F.lit(v) for kv in (mapping or COARSE_TYPES).items() for v in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def entropy2(counts: list[Column]) -> Column:
    """Shannon entropy in bits of a list of counts; NULL when they sum to zero."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(n > 0, (n / total) * F.log2(n / total)).otherwise(F.lit(0.0)) for n in counts]
    return F.when(total > 0, -sum(terms[1:], terms[0]))


IMAGE_NAME = r"(?i)^(.+?)_(real|fake)_(if|he)_(\d+)\.(?:png|jpe?g|tiff?)$"


def image_name(c: Column | str) -> Column:
    """``<marker>_<source>_<kind>_<n>.png`` to a struct, NULL if the name differs."""
    name = F.substring_index(col(c), "/", -1)

    def g(i: int) -> Column:
        return F.regexp_extract(name, IMAGE_NAME, i)

    return F.when(name.rlike(IMAGE_NAME), F.struct(
        F.upper(g(1)).alias("marker"), F.lower(g(2)).alias("source"),
        F.lower(g(3)).alias("kind"), g(4).cast("bigint").alias("idx")))


SLIDE_KEY_RULES = ("ome", "svs", "prefix", "a_to_b")


def slide_key(c: Column | str, rule: str) -> Column:
    c = col(c)
    if rule == "ome":
        return F.replace(c, F.lit(".ome"), F.lit(""))
    if rule == "svs":
        return F.replace(c, F.lit(".svs"), F.lit(""))
    if rule == "prefix":
        return F.substring_index(c, "_", 1)
    if rule == "a_to_b":
        return F.replace(c, F.lit("_A."), F.lit("_B."))
    raise ValueError(f"unknown slide key rule {rule!r}, expected one of {SLIDE_KEY_RULES}")


def tile_xy(c: Column | str) -> Column:
    """``x_y.png`` to struct<x,y>."""
    stem = F.substring_index(F.substring_index(col(c), "/", -1), ".", 1)
    parts = F.split(stem, "_")
    return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("x"),
                    F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("y"))


def rgb_to_int(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return F.shiftleft(col(r).cast("int"), 16) + F.shiftleft(col(g).cast("int"), 8) + col(b).cast("int")


def merge_classes(c: Column | str, groups: dict[int, list[int]] | None = None) -> Column:
    """Fold class ids together; the default keeps 1 and 2 and folds 3,4 and 5,6,7."""
    c = col(c)
    out = c
    for target, members in (groups or {3: [3, 4], 4: [5, 6, 7]}).items():
        out = F.when(c.isin(members), F.lit(target)).otherwise(out)
    return out


def scale_int(c: Column | str, factor: Column | float) -> Column:
    """Rescale a coordinate and truncate towards zero."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return (col(c) * f).cast("bigint")


def magnification_to_microns(c: Column | str) -> Column:
    """Microns per pixel; an unknown magnification fails the query."""
    c = col(c).cast("int")
    out = F.when(F.lit(False), F.lit(0.0))
    for mag, um in MICRONS_PER_PIXEL.items():
        out = out.when(c == mag, F.lit(um))
    return out.otherwise(F.raise_error(F.concat(F.lit("no pixel size for magnification "),
                                                c.cast("string"))).cast("double"))


def tenth_bin(c: Column | str) -> Column:
    """Bin 0..10 of a value in [0,1] by tenths, using remainder division."""
    x = col(c).cast("double")
    return F.rint((x - F.pmod(x, F.lit(0.1))) / F.lit(0.1)).cast("int")


def _linear(c: Column) -> Column:
    c = c / 255.0
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def srgb_to_lab(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """8-bit sRGB to CIE Lab (D65, 2 degree observer) as struct<l,a,b>."""
    rl, gl, bl = (_linear(col(v).cast("double")) for v in (r, g, b))
    # sRGB to XYZ matrix and D65 white point.
    x = (rl * 0.412453 + gl * 0.357580 + bl * 0.180423) / 0.95047
    y = rl * 0.212671 + gl * 0.715160 + bl * 0.072169
    z = (rl * 0.019334 + gl * 0.119193 + bl * 0.950227) / 1.08883

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)

    return F.struct((f(y) * 116.0 - 16.0).alias("l"), ((f(x) - f(y)) * 500.0).alias("a"),
                    ((f(y) - f(z)) * 200.0).alias("b"))


def delta_e76(lab1: Column, lab2: Column) -> Column:
    return F.sqrt(F.pow(lab1["l"] - lab2["l"], 2) + F.pow(lab1["a"] - lab2["a"], 2)
                  + F.pow(lab1["b"] - lab2["b"], 2))


def deconvolve(r: Column | str, g: Column | str, b: Column | str, stain: list[list[float]]) -> Column:
    """Stain separation: log-RGB times a 3x3 matrix, back to intensities, clipped to 0..255."""
    logs = [F.log((col(v).cast("double") + 1.0) / 256.0) for v in (r, g, b)]

    def channel(j: int) -> Column:
        dens = sum((logs[i] * float(stain[i][j]) for i in range(1, 3)), logs[0] * float(stain[0][j]))
        back = F.exp(dens) * 256.0 - 1.0
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), back)) + 0.5).cast("int")

    return F.struct(*[channel(j).alias(f"s{j + 1}") for j in range(3)])


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


# ---- vectors (array<float|double>) -------------------------------------------------

def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, v: s + v)


def norm2(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2norm(a: Column | str, eps: float = 1e-12) -> Column:
    n = F.greatest(norm2(a), F.lit(eps))
    return F.transform(col(a), lambda v: v.cast("double") / n)


def cosine(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm2(a) * norm2(b), F.lit(eps))


def euclid(a: Column | str, b: Column | str) -> Column:
    sq = F.zip_with(col(a), col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))


def hazard_to_risk(logits: Column | str) -> Column:
    """Discrete hazards from logits; risk is minus the sum of the survival curve."""
    start = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("total"))
    run = F.aggregate(
        col(logits), start,
        lambda acc, z: F.struct((acc["s"] * (F.lit(1.0) - sigmoid(z.cast("double")))).alias("s"),
                                (acc["total"] + acc["s"] * (F.lit(1.0) - sigmoid(z.cast("double")))).alias("total")))
    return -run["total"]


def survival_curve(logits: Column | str) -> Column:
    """Running product of one minus hazard, as an array."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        col(logits), empty,
        lambda acc, z: F.concat(acc, F.array(
            F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1.0)) * (F.lit(1.0) - sigmoid(z.cast("double"))))))


def stack_modalities(m: Column | str, order: list[str]) -> Column:
    """Vectors of a modality map as an array in a stated key order."""
    m = col(m)
    return F.array(*[F.try_element_at(m, F.lit(k)) for k in order])
