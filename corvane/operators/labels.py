"""Channel-label rules as column expressions, and joins between channel lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Older electrode names and their present ones; prefixes of scalp regions in the order in which they are tried.
RENAMED = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
REGIONS = [("FP", "frontal"), ("AF", "frontal"), ("F", "frontal"), ("CP", "parietal"), ("P", "parietal"), ("O", "occipital"), ("T", "temporal"), ("C", "central")]


def clean_name(c: Column) -> Column:
    """The part before the first hyphen, trimmed."""
    return F.trim(F.element_at(F.split(c, "-", -1), 1))


def canonical_name(c: Column) -> Column:
    """The present name of an older one, matched in its usual case; others as they are."""
    name = clean_name(c)
    return F.coalesce(F.create_map(*[F.lit(x) for p in RENAMED.items() for x in p])[name], name)


def side(c: Column) -> Column:
    """L for odd digits, R for even ones, M without digits or for names that end in z."""
    name = clean_name(c)
    digits = F.regexp_replace(name, "[^0-9]", "")
    return F.when(F.lower(name).endswith("z") | (digits == ""), "M").when(F.substring(digits, -1, 1).cast("int") % 2 == 1, "L").otherwise("R")


def region(c: Column) -> Column:
    """Scalp region by the prefix of the name as it is written: older names are not renamed first, so T5 is temporal."""
    name = F.upper(clean_name(c))
    out = F.when(F.lit(False), "")
    for prefix, value in REGIONS:
        out = out.when(name.startswith(prefix), value)
    return out.otherwise("other")


def base_electrode(c: Column) -> Column:
    """The part after a slash if any, then its first token between spaces, underscores and hyphens, in upper case."""
    last = F.when(c.contains("/"), F.element_at(F.split(c, "/", -1), -1)).otherwise(c)
    return F.upper(F.element_at(F.split(F.trim(last), "[ _-]", -1), 1))


def mirror(c: Column) -> Column:
    """The electrode on the other side: names that end in Z are their own, odd numbers go up by one, even ones down."""
    base = base_electrode(c)
    number = F.regexp_extract(base, r"([0-9]+)$", 1)
    stem = F.regexp_replace(base, r"[0-9]+$", "")
    return F.when(number == "", F.when(base.endswith("Z"), base)).otherwise(F.concat(stem, F.when(number.cast("int") % 2 == 1, number.cast("int") + 1).otherwise(number.cast("int") - 1).cast("string")))


def homologous_pairs(channels: DataFrame, key: list[str], name: str = "channel") -> DataFrame:
    """(key, channel, mirror) for the channels whose mirror exists in the same list."""
    own = channels.select(*key, F.col(name).alias("channel"), mirror(F.col(name)).alias("m"))
    other = channels.select(*key, F.col(name).alias("mirror"), base_electrode(F.col(name)).alias("m"))
    return own.join(other, [*key, "m"]).select(*key, "channel", "mirror")


def nearest_alias(sources: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(channel, alias, distance): the nearest target on the unit sphere times the targets' median radius, within `radius`.

    Both tables hold (name, x, y, z) and have a row for each electrode of a montage, so targets are few.
    """

    def unit(df: DataFrame, p: str) -> DataFrame:
        r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
        return df.filter(r > 0).select(F.col("name").alias(p), *[(F.col(a) / r).alias(p + a) for a in "xyz"], r.alias(p + "r"))

    t = unit(targets, "t")
    scale = t.agg(F.coalesce(F.percentile("tr", 0.5), F.lit(0.095)).alias("scale"))
    d = F.sqrt(sum((F.col("s" + a) - F.col("t" + a)) ** 2 for a in "xyz")) * F.col("scale")
    near = unit(sources, "s").crossJoin(F.broadcast(t.crossJoin(scale))).withColumn("d", d).groupBy(F.col("s").alias("channel")).agg(F.min(F.struct("d", "t")).alias("m"))
    return near.filter(F.col("m.d") <= radius).select("channel", F.col("m.t").alias("alias"), F.col("m.d").alias("distance"))


def display_label(name: Column, alias: Column, override: Column | None = None) -> Column:
    """An override, else name/alias, else the name."""
    plain = F.when(alias.isNotNull(), F.concat_ws("/", name, alias)).otherwise(name)
    return plain if override is None else F.coalesce(override, plain)


def without_reference(c: Column) -> Column:
    """The trimmed name without one suffix that names a reference, for display."""
    return F.regexp_replace(F.trim(c), "(?i)-(LE|REF|AVG)$", "")


def contract_failures(channels: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose channel names are not unique, with counts."""
    return channels.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("channel").alias("n_distinct")).filter("n <> n_distinct")


def inconsistent_subjects(channels: DataFrame) -> DataFrame:
    """(subject, n): subjects whose ordered channel list differs from that of the first subject."""
    lists = channels.groupBy("subject").agg(F.concat_ws(",", F.array_sort(F.collect_list("channel"))).alias("names"), F.count(F.lit(1)).alias("n"))
    first = lists.agg(F.min_by("names", "subject").alias("expected"))
    return lists.crossJoin(F.broadcast(first)).filter("names <> expected").select("subject", "n")


def resolve_band(name: Column, index: Column, bands: Column) -> Column:
    """An explicit band name, else the entry of the band list at a zero-based index, else null."""
    return F.coalesce(name, F.try_element_at(bands, index + 1))


def split_unit(c: Column) -> tuple[Column, Column]:
    """subject and band of a key subject::band, split at its last double colon; null without one."""
    def part(i: int) -> Column:
        return F.when(c.contains("::"), F.regexp_extract(c, r"(?s)^(.*)::(.*)$", i))

    return part(1), part(2)


def order_channels(channels: DataFrame) -> DataFrame:
    return channels.withColumn("ord", F.row_number().over(Window.partitionBy("subject").orderBy("channel")) - 1)
