"""Scalar expressions. All of them are built-in Catalyst functions, no Python per row."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ARM_NAMES, BANDS

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- names, paths and zones -------------------------------------------------


def slashes(c: ColumnOrName) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def base_name(c: ColumnOrName) -> Column:
    return F.substring_index(slashes(c), "/", -1)


def group_key(c: ColumnOrName) -> Column:
    """Source group of an item: its base name up to the last ``_ann``, whole when there is none."""
    base = base_name(c)
    return F.when(F.contains(base, F.lit("_ann")), F.regexp_extract(base, r"(?s)^(.*)_ann", 1)).otherwise(base)


def crop_name(file_name: ColumnOrName, annotation_id: ColumnOrName) -> Column:
    flat = F.replace(slashes(file_name), F.lit("/"), F.lit("_"))
    return F.concat(F.replace(flat, F.lit(".jpg"), F.lit("")), F.lit("_ann"), col(annotation_id).cast("string"), F.lit(".jpg"))


def _digits_mod6(digits: Column) -> Column:
    # a digit string of any length: parity from its last digit, mod 3 from its digit sum
    total = F.lit(0)
    for d in range(1, 10):
        total = total + F.lit(d) * (F.length(digits) - F.length(F.replace(digits, F.lit(str(d)), F.lit(""))))
    odd = F.try_to_number(F.right(digits, F.lit(1)), F.lit("9")).cast("int") % 2
    return (F.lit(3) * odd + F.lit(4) * (total % 3)) % 6


def zone_from_batch(c: ColumnOrName) -> Column:
    """``batch_<n>_...`` falls into one of six zones by n; any other name is Unassigned."""
    digits = F.regexp_extract(base_name(c), r"(?s)^batch_([0-9]+)(?:_.*)?$", 1)
    short = F.when(F.length(digits) <= 18, F.pmod(digits.try_cast("bigint") - 1, F.lit(6)))
    slot = F.coalesce(short, F.pmod(_digits_mod6(digits) - 1, F.lit(6)))
    return F.when(digits == "", F.lit("Unassigned")).otherwise(F.concat(F.lit("Zone "), F.char(slot + 65)))


def zone_from_folder(c: ColumnOrName) -> Column:
    parts = F.split(slashes(c), "/")
    grand = F.when(F.size(parts) >= 3, F.element_at(parts, -3))
    return F.when(grand.startswith("Zone"), grand).otherwise(F.lit("Unassigned"))


def zone_of(path: ColumnOrName, zone_dir: ColumnOrName | None = None) -> Column:
    """An explicit zone wins over the batch rule."""
    batch = zone_from_batch(path)
    return batch if zone_dir is None else F.coalesce(F.nullif(col(zone_dir), F.lit("")), batch)


def arm_label(arm: ColumnOrName, n_components: int, k: int | None = None) -> Column:
    pairs = [F.lit(x) for item in ARM_NAMES.items() for x in item]
    base = F.try_element_at(F.create_map(*pairs), col(arm))
    if k is not None:
        base = F.concat(base, F.lit(f"-{k}"))
    return F.when(col(arm) == "Z_full", F.lit(f"Full-{n_components}")).otherwise(base)


def canonical_id(c: ColumnOrName) -> Column:
    """Identifier text in which integer 0 and float 0.0 collide; input is a number or a string."""
    number = col(c).try_cast("double")
    whole = (F.typeof(col(c)).isin("double", "float")) & (number == F.floor(number))
    return F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(col(c).cast("string"))


# ---- path and URL screening -------------------------------------------------


def is_unsafe_path(c: ColumnOrName) -> Column:
    """Empty, absolute under either convention, with a drive, or climbing out by ``..``."""
    p = F.coalesce(col(c), F.lit(""))
    climbs = F.array_contains(F.split(slashes(p), "/"), "..")
    return (p == "") | p.rlike(r"^[/\\]") | p.rlike(r"^[A-Za-z]:") | climbs


def is_nonportable_path(c: ColumnOrName) -> Column:
    """A relative path that some file system would refuse or read differently."""
    p = F.coalesce(col(c), F.lit(""))

    def bad(part: Column) -> Column:
        return (
            part.isin("", ".", "..")
            | part.rlike(r"[. ]$")
            | part.rlike(r'[\x00-\x1f<>:"|?*]')
            | part.rlike(r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)")
        )

    return (p == "") | p.rlike(r"^[A-Za-z]:") | F.exists(F.split(slashes(p), "/"), bad)


def portable_key(c: ColumnOrName) -> Column:
    return F.lower(slashes(c))


def url_problem(c: ColumnOrName, hosts: tuple[str, ...]) -> Column:
    """Reason a URL is refused, NULL when it is fine. Without a scheme it addresses no host."""
    u = F.coalesce(col(c), F.lit(""))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    allowed = F.lit(False)
    for name in hosts:
        allowed = allowed | (host == name) | host.endswith("." + name)
    return (
        F.when(u == "", F.lit("empty"))
        .when(scheme == "", F.lit(None).cast("string"))
        .when(scheme != "https", F.lit("scheme"))
        .when(F.contains(u, F.lit("@")), F.lit("userinfo"))
        .when(F.contains(u, F.lit("\\")), F.lit("backslash"))
        .when(~allowed, F.lit("host"))
    )


# ---- numbers ----------------------------------------------------------------


def wilson(successes: ColumnOrName, n: ColumnOrName, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score bounds; no observations give (0, 1), impossible counts fail the job."""
    if not 0 < z < float("inf"):
        raise ValueError("z must be finite and positive")
    s, n = col(successes), col(n)
    bad = (n < 0) | (s < 0) | (s > n)
    nn = F.when(bad, F.raise_error(F.lit("need 0 <= successes <= n")).cast("double")).when(n > 0, n.cast("double"))
    p = s / nn
    scale = 1 + z * z / nn
    centre = p + z * z / (2 * nn)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * nn)) / nn)
    none = (n == 0) & (s == 0)
    low = F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (centre - spread) / scale))
    high = F.when(none, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (centre + spread) / scale))
    return low, high


def bonferroni_z(m: int, alpha: float = 0.05) -> float:
    """Normal quantile for m two-sided bounds at a joint level; a constant of the query."""
    return NormalDist().inv_cdf(1 - alpha / (2 * m))


def band_of(index: ColumnOrName, bands=BANDS) -> Column:
    out = None
    for top, name in bands:
        test = col(index) <= top
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def clamp(c: ColumnOrName, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def interval_text(low: ColumnOrName, high: ColumnOrName) -> Column:
    return F.format_string("[%d-%d]", col(low).cast("bigint"), col(high).cast("bigint"))


def tolerance(std: ColumnOrName, sigma: float, floor: float = 0.01) -> Column:
    s = col(std)
    return F.when(s.isNull(), F.lit(0.0)).otherwise(F.lit(float(sigma)) * F.when(s > 0, s).otherwise(F.lit(floor)))


def iso_timestamp(c: ColumnOrName) -> Column:
    """ISO-8601 text to a timestamp; a missing zone is UTC (the session's), anything else NULL."""
    t = F.trim(col(c).cast("string"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))


def age_days(ts: ColumnOrName, now: str) -> Column:
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(col(ts))
    return micros / F.lit(86400e6)


def is_finite(c: ColumnOrName) -> Column:
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def size_text(n: ColumnOrName) -> Column:
    n = col(n)
    mb, kb = F.lit(1024.0 * 1024.0), F.lit(1024.0)
    return F.when(n >= 1024 * 1024, F.format_string("%.1f MB", F.bround(n / mb, 1))).otherwise(
        F.format_string("%.1f kB", F.bround(n / kb, 1))
    )


def join_indices(c: ColumnOrName) -> Column:
    return F.array_join(F.transform(col(c), lambda i: i.cast("string")), ",")


def split_indices(c: ColumnOrName) -> Column:
    parts = F.filter(F.split(col(c), ","), lambda s: s != "")
    return F.transform(parts, lambda s: s.cast("int"))


def short_hash(c: ColumnOrName, digits: int = 16) -> Column:
    return F.left(F.sha2(col(c).cast("binary"), 256), F.lit(digits))


def seeded_hash(seed: ColumnOrName, key: ColumnOrName) -> Column:
    """Repeatable pseudo-random order of keys: the same in every run, task and engine."""
    return F.md5(F.concat(col(seed).cast("string"), F.lit(":"), col(key).cast("string")).cast("binary"))
