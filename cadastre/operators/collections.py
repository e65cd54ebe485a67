"""Sets, nested blocks, ranges and orders as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions.collections import LATEST, version_key
from cadastre.functions.validators import CIDR, ipv4_number
from cadastre.session import materialise

TIERS = ("none", "core", "extended", "all")


def first_duplicates(rows: DataFrame, parent: str, value: str, order: str) -> DataFrame:
    """First value of each parent that an earlier row already had, ignoring case.

    Folds to the first place of every value, then takes the least later place,
    so no group is sorted in one task.
    """
    folded = rows.select(parent, F.lower(value).alias("folded"), F.col(value).alias("value"), F.col(order).alias("place"))
    first = folded.groupBy(parent, "folded").agg(F.min("place").alias("first"))
    later = folded.join(first, [parent, "folded"]).where("place > first")
    return later.groupBy(parent).agg(F.min(F.struct("place", "value")).alias("d")).select(parent, "d.place", "d.value")


def required_vs_registered(required: DataFrame, states: DataFrame) -> DataFrame:
    """Decision per required name: skip if registered, register if known, warn if unknown."""
    known = states.groupBy("name").agg(F.bool_or(F.lower("state") == "registered").alias("registered"))
    return required.select("name").distinct().join(known, "name", "left").select(
        "name",
        F.when(F.col("registered"), "skip").when(F.col("registered").isNotNull(), "register").otherwise("warn").alias("decision"),
    )


def tier_members(members: DataFrame, tier: str) -> DataFrame:
    """Names of a tier (tier, name) and of every tier below it."""
    if tier.lower() not in TIERS:
        raise ValueError(f"unsupported value {tier!r} for a tier")
    wanted = TIERS[: TIERS.index(tier.lower()) + 1]
    return members.where(F.col("tier").isin(list(wanted))).select("name").distinct()


def expected_members_done(expected: DataFrame, linked: DataFrame, wanted_state: str) -> DataFrame:
    """Per group: are all expected members in the wanted state, and are all of them gone.

    ``expected`` has (group, member), ``linked`` (group, member, state).
    """
    seen = linked.groupBy("group", "member").agg(F.bool_or(F.col("state") == wanted_state).alias("in_state"))
    return (
        expected.distinct()
        .join(seen, ["group", "member"], "left")
        .groupBy("group")
        .agg(
            F.bool_and(F.coalesce("in_state", F.lit(False))).alias("all_linked"),
            F.bool_and(F.col("in_state").isNull()).alias("all_unlinked"),
        )
    )


def set_delta(old: DataFrame, new: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Members (group, member) with what to do: remove, keep or add."""
    key = F.lower("member") if ignore_case else F.col("member")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("group", key.alias("key")).agg(F.min("member").alias(name))

    return side(old, "o").join(side(new, "n"), ["group", "key"], "full_outer").select(
        "group",
        F.coalesce("o", "n").alias("member"),
        F.when(F.col("n").isNull(), "remove").when(F.col("o").isNull(), "add").otherwise("keep").alias("action"),
    )


def plan_positions(delta: DataFrame) -> DataFrame:
    """Linked members (group, position, member, action), kept ones first, each group from 1.

    The step that adds the member at a position links all members up to it, so the whole plan
    is one row a member. Members are sorted into ranges, ranked inside a range, and the sizes of the
    ranges before are added: a group of any size is ranked by many tasks.
    """
    linked = delta.where("action <> 'remove'").select("group", (F.col("action") == "add").alias("added"), "member", "action")
    ranges = materialise(linked.repartitionByRange("group", "added", "member").withColumn("range", F.spark_partition_id()), "plan")
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("group", "range").agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("group", "range").orderBy("added", "member")
    return (
        ranges.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["group", "range"])
        .select("group", (F.col("offset") + F.col("rank")).alias("position"), "member", "action")
    )


def link_plan(delta: DataFrame) -> DataFrame:
    """One step per added member with all members linked so far, in member order.

    Kept members come first. The running list is the result itself, so a step is
    as long as its group of linked members; ``plan_positions`` gives the same plan in
    one row a member, for groups of any size.
    """
    order = Window.partitionBy("group").orderBy(F.col("action") == "add", "member").rowsBetween(Window.unboundedPreceding, 0)
    return (
        delta.where("action <> 'remove'")
        .withColumn("ids", F.collect_list("member").over(order))
        .where("action = 'add'")
        .select("group", F.col("member").alias("id"), "ids")
    )


def unlink_plan(delta: DataFrame) -> DataFrame:
    """Removals one by one against the first kept member; none where nothing is kept."""
    kept = delta.where("action = 'keep'").groupBy("group").agg(F.min("member").alias("id"))
    return delta.where("action = 'remove'").join(kept, "group").select("group", "id", F.array("member").alias("ids"))


def flatten_block(rows: DataFrame, column: str) -> DataFrame:
    """An object column to a list of one object; a null object gives an empty list."""
    block = F.when(F.col(column).isNull(), F.array()).otherwise(F.array(column))
    return rows.withColumn(column, block)


def expand_block(rows: DataFrame, column: str) -> DataFrame:
    """A list column to its first object; empty lists and null firsts give null."""
    return rows.withColumn(column, F.get(F.col(column), F.lit(0)))


def explode_blocks(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Nested blocks to rows; rows without blocks stay, with nulls."""
    return rows.select(key, F.inline_outer(column))


def collect_blocks(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Rows back to nested blocks, sorted by ``order``. A group is one parent object."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("blocks"))


def cidr_bounds(rows: DataFrame, column: str = "cidr") -> DataFrame:
    """Network number and prefix length of IPv4 blocks, with an error for bad text."""
    good = F.col(column).rlike(CIDR)
    address, bits = F.split_part(column, F.lit("/"), F.lit(1)), F.split_part(column, F.lit("/"), F.lit(2)).try_cast("int")
    number = ipv4_number(address)
    return rows.select(
        "*",
        F.when(good, bits).alias("bits"),
        F.when(good, number - number % F.pow(F.lit(2), 32 - bits).cast("long")).alias("network"),
        F.when(~good, "invalid CIDR address").alias("error"),
    )


def cidr_overlaps(left: DataFrame, right: DataFrame, most: int = 100_000) -> DataFrame:
    """All pairs (l, r) of overlapping blocks from two columns ``cidr``.

    Two blocks overlap if and only if one holds the other. So every block is
    listed under the networks that hold it, as far as the other side has blocks of that length,
    and looked up there by equality: no range join, and no more than 33 keys per distinct block. A
    network that holds more than ``most`` blocks is dealt in parts, and the blocks of that very
    network go to each part.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        found = cidr_bounds(df.select("cidr").distinct()).where("error IS NULL")
        return found.select(F.col("cidr").alias(name), "network", "bits")

    def holders(df: DataFrame, name: str, others: DataFrame) -> DataFrame:
        size = F.pow(F.lit(2), F.lit(32) - F.col("at")).cast("long")
        listed = df.select(name, "network", F.col("bits").alias("own"), F.explode(F.sequence(F.lit(0), F.col("bits"))).alias("at"))
        # at most 33 lengths
        lengths = F.broadcast(others.select(F.col("bits").alias("at")).distinct())
        return listed.join(lengths, "at").select(
            name, (F.col("network") - F.col("network") % size).alias("network"), F.col("at").alias("bits"), "own"
        )

    def meet(held: DataFrame, name: str, holding: DataFrame) -> DataFrame:
        key = ["network", "bits"]
        large = held.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most)
        parts = large.select(*key, F.ceil(F.col("n") / most).cast("int").alias("parts"))
        one = F.coalesce("parts", F.lit(1))
        dealt = held.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64(name), one).cast("int"))
        copied = holding.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1)))
        return dealt.drop("parts").join(copied.drop("parts"), [*key, "part"]).select("l", "r")

    a, b = blocks(left, "l"), blocks(right, "r")
    # equal blocks are found on the first way
    return meet(holders(a, "l", b), "l", b).unionByName(meet(holders(b, "r", a).where("bits < own"), "r", a))


def semver_sort(rows: DataFrame, column: str) -> DataFrame:
    """Rows by version number; bad versions come last with an error."""
    keyed = rows.withColumn("version_key", version_key(F.col(column)))
    return keyed.withColumn("error", F.when(F.col("version_key").isNull(), "Malformed version")).orderBy(
        F.col("version_key").asc_nulls_last(), column
    )


def latest_per_group(rows: DataFrame, group: str, column: str) -> DataFrame:
    """Greatest version per group; the words latest and recent are no versions."""
    numbered = rows.where(~F.lower(column).isin(list(LATEST))).withColumn("version_key", version_key(F.col(column)))
    return (
        numbered.where("version_key IS NOT NULL")
        .groupBy(group)
        .agg(F.max(F.struct("version_key", F.col(column).alias("version"))).alias("m"))
        .select(group, F.col("m.version").alias("latest"))
    )


def resolve_latest(wanted: DataFrame, latest: DataFrame, group: str, column: str) -> DataFrame:
    """Wanted versions, with the words latest and recent replaced by the group's greatest."""
    word = F.lower(column).isin(list(LATEST))
    return wanted.join(latest, group, "left").withColumn(
        "resolved", F.when(word, F.col("latest")).otherwise(F.col(column))
    ).drop("latest")


def exclude_default(rows: DataFrame, column: str, reserved: str = "Default Site") -> DataFrame:
    """Rows without the reserved name; a null name stays."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(reserved)))
