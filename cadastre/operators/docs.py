"""Checks of documentation pages against schemas.

Lines are rows (page, line_no, text). Windows and gathered lists are per page,
and a page is one file, so no group outgrows a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions import pages as px
from cadastre.session import materialise, release, scratch_path

# Section patterns (the last that matches wins) and expected headings.
SECTION_PATTERNS = {
    "front_matter": r"^---",
    "title": r"#+\s*([a-zA-Z0-9\s]*:\s*)?\w*_[\w_]*",
    "example": r"(?i)example|usage",
    "arguments": r"(?i)#+(\s)*argument.*",
    "attributes": r"(?i)#+(\s)*attribute.*",
    "timeouts": r"(?i)#+(\s)*timeout.*",
    "apis": r"(?i)#+(\s)*api providers.*",
}
POSITION_PATTERNS = {
    "example": r"## Example",
    "args": r"## Arguments? Reference",
    "attr": r"## Attributes? Reference",
    "timeout": r"## Timeouts?",
    "import": r"## Imports?",
}
ARGUMENTS_HEADING = "Arguments Reference"
ATTRIBUTES_HEADING = "Attributes Reference"
MAX_MISSPELLING = 3
#: Names of the smaller side of a resource up to which every pair is measured; a name has some forty keys.
FEW_NAMES = 32


def sectionise_page(lines: DataFrame) -> DataFrame:
    """Add section number, type, heading, level and checked position to each line.

    Headings start sections, and so does front matter in the first line. Lines
    above the first heading belong to the first section.
    """
    down = Window.partitionBy("page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = F.col("text")
    heading = text.startswith("#") | ((F.col("line_no") == 0) & text.startswith("---"))
    kind = F.lit("unknown")
    for name, pattern in SECTION_PATTERNS.items():
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    hashed = text.startswith("#")
    position = F.coalesce(
        *(F.when(hashed & text.rlike(p), n) for n, p in POSITION_PATTERNS.items()),
        F.when(hashed & text.startswith("##") & ~text.startswith("###"), F.lit("other")),
    )
    found = F.when(
        heading,
        F.struct(
            kind.alias("section_type"),
            F.length(F.regexp_extract("text", r"^(#{1,6})", 1)).alias("level"),
            px.trimmed(F.regexp_extract("text", r"^#{1,6}(.*)$", 1)).alias("heading"),
        ),
    )
    return lines.select(
        "page",
        "line_no",
        "text",
        heading.alias("is_heading"),
        F.greatest(F.sum(heading.cast("int")).over(down), F.lit(1)).alias("section_no"),
        F.last(found, ignorenulls=True).over(down).alias("s"),
        F.last(position, ignorenulls=True).over(down).alias("position"),
    ).select("page", "line_no", "text", "is_heading", "section_no", "s.*", "position")


def sections(sectioned: DataFrame) -> DataFrame:
    """One row per section."""
    return sectioned.where("is_heading").select("page", "section_no", "section_type", "level", "heading", "line_no")


def find_section(section_rows: DataFrame, search: str) -> DataFrame:
    """First section of each page whose heading contains ``search``, ignoring case."""
    hit = section_rows.where(F.contains(F.lower("heading"), F.lit(search.lower())))
    rest = [c for c in section_rows.columns if c != "page"]
    return hit.groupBy("page").agg(F.min_by(F.struct(*rest), "section_no").alias("s")).select("page", "s.*")


def insert_section(section_rows: DataFrame, heading: str, anchor_type: str, after: bool = True) -> DataFrame:
    """Place a new section before or after the first one of a type, and renumber.

    Pages without such a section are left as they are.
    """
    columns = ["page", "section_no", "section_type", "heading"]
    anchors = (
        section_rows.where(F.col("section_type") == anchor_type).groupBy("page").agg(F.min("section_no").alias("anchor"))
    )
    moved = F.col("section_no") > F.col("anchor") if after else F.col("section_no") >= F.col("anchor")
    kept = section_rows.join(anchors, "page", "left").select(
        "page",
        (F.col("section_no") + F.coalesce(moved, F.lit(False)).cast("int")).alias("section_no"),
        "section_type",
        "heading",
    )
    new = anchors.select(
        "page", (F.col("anchor") + int(after)).alias("section_no"), F.lit("new").alias("section_type"), F.lit(heading).alias("heading")
    )
    return kept.unionByName(new).select(*columns)


def parse_field_lines(lines: DataFrame) -> DataFrame:
    """Fields documented on list lines.

    Possible values are the code words of the sentence that names them.
    """
    text = F.col("text")
    name = F.regexp_extract("text", px.FIELD, 1)
    block = px.is_block_field(text)
    return lines.where(text.rlike(px.FIELD)).select(
        *lines.columns,
        name.alias("name"),
        F.translate(F.lower(F.regexp_extract("text", px.FIELD, 2)), "()", "").alias("requirement"),
        px.default_value(text).alias("default_value"),
        px.is_force_new(text).alias("force_new"),
        block.alias("is_block"),
        F.when(block, F.coalesce(F.nullif(F.regexp_extract("text", px.BLOCK_FIELD_ANY_CASE, 1), F.lit("")), name)).alias("block_type"),
        px.possible_values(text).alias("enums"),
    )


def block_heads(lines: DataFrame) -> DataFrame:
    """Block heading lines with the names they define, and lines that look like one."""
    text = F.col("text")
    looks = text.rlike(px.BLOCK_HEAD_TRY) | (F.contains(text, F.lit("supports")) & text.endswith(":"))
    return lines.where(text.rlike(px.BLOCK_HEAD) | looks).select(
        *lines.columns, text.rlike(px.BLOCK_HEAD).alias("is_head"), px.block_names(text).alias("names")
    )


def same_block_definitions(fields: DataFrame) -> DataFrame:
    """Blocks defined more than once in a page, and whether all definitions agree.

    ``fields`` has (page, block, block_line, line_no, name, requirement).
    """
    listed = F.sort_array(F.collect_list(F.struct("line_no", "name", "requirement")))
    definition = F.transform(listed, lambda f: F.concat_ws(":", f["name"], f["requirement"]))
    return (
        fields.groupBy("page", "block", "block_line")
        .agg(F.array_join(definition, ",").alias("definition"))
        .groupBy("page", "block")
        .agg(F.count("*").alias("definitions"), (F.min("definition") == F.max("definition")).alias("same"))
        .where("definitions > 1")
    )


def normalise_lines(lines: DataFrame) -> DataFrame:
    """Lines with spaces and markers in order."""
    return lines.withColumn("text", px.normalise_line(F.col("text")))


def fix_block_heads(lines: DataFrame) -> DataFrame:
    """Lines that look like block headings but are none, and how they should read."""
    return (
        block_heads(lines)
        .where("NOT is_head")
        .select("page", "line_no", "text", px.fix_block_head(F.col("text")).alias("fixed"))
    )


def attach_blocks(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """Line of the block that a block field refers to, else what is wrong with it.

    ``fields`` has (page, line_no, name, block_type), ``blocks`` (page, block,
    block_line). The first definition of a block counts.
    """
    first = blocks.groupBy("page", "block").agg(F.min("block_line").alias("block_line"))
    by_type = first.withColumnRenamed("block", "block_type")
    by_name = first.select("page", F.col("block").alias("name"), F.col("block_line").alias("name_line"))
    return (
        fields.join(by_type, ["page", "block_type"], "left")
        .join(by_name, ["page", "name"], "left")
        .select(
            "page", "line_no", "name", "block_type", "block_line",
            F.when(
                F.col("block_line").isNull(),
                F.when(
                    F.col("name_line").isNotNull(),
                    F.format_string("misspell of name from `%s` to `%s`", "name", "block_type"),
                ).otherwise(F.format_string("`%s` block is not defined in the documentation", "name")),
            ).alias("error"),
        )
    )


def merge_args_attrs(arguments: DataFrame, attributes: DataFrame) -> DataFrame:
    """Arguments and attributes by name; on a clash the argument stays and holds the attribute's line."""
    a = arguments.select("page", "name", F.col("line_no").alias("a_line"))
    t = attributes.select("page", "name", F.col("line_no").alias("t_line"))
    return a.join(t, ["page", "name"], "full_outer").select(
        "page",
        "name",
        F.when(F.col("a_line").isNotNull(), "argument").otherwise("attribute").alias("side"),
        F.coalesce("a_line", "t_line").alias("line_no"),
        F.when(F.col("a_line").isNotNull(), F.col("t_line")).alias("same_name_attribute"),
    )


def cross_check(schema: DataFrame, documented: DataFrame) -> DataFrame:
    """(resource, name, miss): in schema but not in page, or in page but not in schema."""
    s = schema.select("resource", "name").distinct().withColumn("in_schema", F.lit(True))
    d = documented.select("resource", "name").distinct().withColumn("in_page", F.lit(True))
    return (
        s.join(d, ["resource", "name"], "full_outer")
        .where("in_schema IS NULL OR in_page IS NULL")
        .select(
            "resource", "name",
            F.when(F.col("in_page").isNull(), "miss_in_doc").otherwise("miss_in_code").alias("miss"),
        )
    )


def _leaf(name: str) -> Column:
    return F.substring_index(name, ".", -1)


def _piece_keys(distance: int, kind: str, shorter_by: range, own: bool = False) -> Column:
    """Keys under which names shorter by so many letters may stand; ``own``: the keys of the name's own pieces.

    A name of n letters has ``distance`` + 1 pieces; the later ones take what does not divide. Piece
    i of the shorter name stands in the longer one, moved by no more than the edits before it
    (at most i) and after it (at most ``distance`` - i) allow. The ways to look are one
    constant list, so a name costs one short loop.
    """
    ways = [
        (delta, i, moved)
        for delta in shorter_by for i in range(distance + 1)
        for moved in range(max(-i, delta - (distance - i)), min(i, delta + distance - i) + 1)
        if not own or moved == 0
    ]
    listed = F.array(*(F.struct(F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(m).alias("moved")) for d, i, m in ways))
    length, pieces = F.length("leaf"), distance + 1

    def start(way: Column, more: int) -> Column:
        return F.floor((length - way["delta"]) * (way["i"] + more) / pieces).cast("int")

    def fits(way: Column) -> Column:
        return (length - way["delta"] > distance) & (start(way, 0) + way["moved"] >= 0) & (start(way, 1) + way["moved"] <= length)

    def key(way: Column) -> Column:
        part = F.substr("leaf", start(way, 0) + way["moved"] + 1, start(way, 1) - start(way, 0))
        return F.xxhash64("resource", F.lit(kind), length - way["delta"], way["i"], part)

    return F.transform(F.filter(listed, fits), key)


def _short_keys(distance: int, one: str, other: str) -> Column:
    """Keys by which short names, of up to ``distance`` letters, meet each other and longer ones.

    Two short names are always within the distance. Of a short name and a longer one of m
    letters, both hold the same m - distance letters in the same order. A short name has the keys of its
    subsequences under ``one``, a longer one those of this length under ``other``.
    """
    def grown(texts: Column, letter: Column) -> Column:
        longer = F.transform(F.filter(texts, lambda t: F.length(t) < distance), lambda t: F.concat(t, letter))
        return F.array_distinct(F.concat(texts, longer))

    n = F.length("leaf")
    every = F.aggregate(F.split("leaf", ""), F.array(F.lit("")), grown)
    key = lambda kind, t: F.xxhash64("resource", F.lit(kind), F.length(t), t)
    of_short = F.transform(F.filter(every, lambda t: t != ""), lambda t: key(one, t))
    of_longer = F.transform(F.filter(every, lambda t: F.length(t) == n - distance), lambda t: key(other, t))
    return F.when(n <= distance, F.array_append(of_short, F.xxhash64("resource", F.lit("short")))).when(n <= 2 * distance, of_longer).otherwise(F.array())


def close_names(left: DataFrame, right: DataFrame, distance: int = MAX_MISSPELLING) -> DataFrame:
    """Pairs (resource, l, r) of leaf names within an edit distance, inside one resource.

    Names are gathered by resource. Where one side has at most ``FEW_NAMES`` of them, all are measured: that
    is less than the keys below would cost. Elsewhere keys tell what may meet: of two names of more than
    ``distance`` letters the longer one holds one of the ``distance`` + 1 pieces of the shorter
    one, shifted as far as their lengths and the edits allow; a shorter name meets others by its
    subsequences. All ways are one join by 64-bit keys, none of them of an empty piece. Both ways are exact.
    """
    def gathered(df: DataFrame, names: str) -> DataFrame:
        return df.groupBy("resource").agg(F.collect_set("leaf").alias(names))

    def keyed(names: str, alias: str, *keys: Column) -> DataFrame:
        # keys take far more time than names take space, so the names of a resource are dealt over all tasks
        parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = met.where(~few).select("resource", F.explode(names).alias("leaf")).repartition(parts, "resource", "leaf")
        return dealt.select("resource", F.col("leaf").alias(alias), F.explode(F.concat(*keys)).alias("key"))

    met = materialise(gathered(left, "ls").join(gathered(right, "rs"), "resource"), "names")
    few = F.least(F.size("ls"), F.size("rs")) <= FEW_NAMES
    near = F.levenshtein("l", "r", distance) >= 0
    measured = met.where(few).select("resource", F.explode("ls").alias("l"), "rs").select("resource", "l", F.explode("rs").alias("r")).where(near)
    every, longer = range(distance + 1), range(1, distance + 1)
    a = keyed("ls", "l", _piece_keys(distance, "left", range(1), True), _piece_keys(distance, "right", longer), _short_keys(distance, "left short", "right short"))
    b = keyed("rs", "r", _piece_keys(distance, "right", range(1), True), _piece_keys(distance, "left", every), _short_keys(distance, "right short", "left short"))
    return measured.unionByName(a.join(b, ["resource", "key"]).where(near).select("resource", "l", "r").distinct())


def merge_misspellings(misses: DataFrame) -> DataFrame:
    """Pair page-only with schema-only names of nearly the same spelling.

    All pairs are kept. A pair with one leaf and a nested target is in the wrong
    place. Misses without a partner stay as they are. The misses and the near
    pairs are each read several times, so they are written once.
    """
    rows = materialise(misses.withColumn("leaf", _leaf("name")), "misses")
    code, doc = rows.where("miss = 'miss_in_code'"), rows.where("miss = 'miss_in_doc'")
    near = materialise(close_names(code, doc), "near")
    pairs = (
        code.select("resource", "name", F.col("leaf").alias("l"))
        .join(near, ["resource", "l"])
        .join(doc.select("resource", F.col("name").alias("correct_name"), F.col("leaf").alias("r")), ["resource", "r"])
    )
    wrong_place = (F.col("l") == F.col("r")) & F.contains("correct_name", F.lit("."))
    paired = pairs.select(
        "resource", "name", F.when(wrong_place, "wrong_place").otherwise("misspelling").alias("miss"), "correct_name"
    )
    used = near.select("resource", F.lit("miss_in_code").alias("miss"), F.col("l").alias("leaf")).unionByName(
        near.select("resource", F.lit("miss_in_doc").alias("miss"), F.col("r").alias("leaf"))
    )
    alone = rows.join(used.distinct(), ["resource", "miss", "leaf"], "left_anti").select(
        "resource", "name", "miss", F.lit(None).cast("string").alias("correct_name")
    )
    return paired.unionByName(alone)


def possible_values_diff(rows: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Wanted values missing in ``got`` and spare ones in it; nothing if none are wanted."""
    fold = F.lower if ignore_case else (lambda c: c)

    def lacking(values: str, others: str) -> Column:
        folded = F.transform(others, lambda v: fold(v))
        return F.filter(values, lambda v: ~F.array_contains(folded, fold(v)))

    return (
        rows.where(F.size("want") > 0)
        .select("*", lacking("want", "got").alias("missed"), lacking("got", "want").alias("spare"))
        .where((F.size("missed") > 0) | (F.size("spare") > 0))
    )


def _required_miss() -> Column:
    said = F.coalesce("requirement", F.lit(""))
    return (
        F.when(F.col("required") & (said != "required"), "should_be_required")
        .when(F.col("optional") & (said != "optional"), "should_be_optional")
        .when(F.col("computed") & ~F.col("optional") & ~F.col("required") & (said != ""), "should_be_computed")
    )


def required_diff(pairs: DataFrame) -> DataFrame:
    """What the mark of a documented property should be, where it is not right.

    ``pairs`` has the schema's required/optional/computed and the page's
    ``requirement``. Inferred from the enum and the fixer.
    """
    return pairs.withColumn("miss", _required_miss()).where("miss IS NOT NULL")


def _defaults() -> tuple[Column, Column]:
    return F.coalesce("schema_default", F.lit("")), F.coalesce("page_default", F.lit(""))


def default_diff(pairs: DataFrame) -> DataFrame:
    """Documented default against the schema's; an empty wanted value means there should be none."""
    want, got = _defaults()
    return pairs.where(want != got).withColumn("default_value", want).withColumn("current_value", got)


def _forces_new() -> tuple[Column, Column]:
    return F.coalesce("schema_force_new", F.lit(False)), F.coalesce("page_force_new", F.lit(False))


def force_new_diff(pairs: DataFrame) -> DataFrame:
    """Pages that should, or should not, say that a change forces a new resource."""
    want, got = _forces_new()
    return pairs.where(want != got).withColumn(
        "miss", F.when(want, "should_be_force_new").otherwise("should_be_not_force_new")
    )


def pair_fixes(correct_name: Column) -> Column:
    """The fixes (seq, kind, arg, arg2) of a documented property, as an array in their order.

    Takes the columns of ``pairs`` (name, and those of the three diffs above); ``correct_name`` is the name
    that was meant, null where ``name`` is right. All kinds come from one pass over the pairs.
    """
    (default, said), (forces, says) = _defaults(), _forces_new()

    def fix(seq: int, kind: str, when: Column, arg: Column, arg2: Column | None = None) -> Column:
        second = F.lit("") if arg2 is None else arg2
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), arg.alias("arg"), second.alias("arg2")))

    return F.array_compact(
        F.array(
            fix(1, "required", _required_miss().isNotNull(), _required_miss()),
            fix(2, "default", default != said, default),
            fix(3, "force_new", forces != says, forces.cast("string")),
            fix(4, "misspelling", correct_name.isNotNull(), F.col("name"), correct_name),
        )
    )


def page_timeouts(lines: DataFrame) -> DataFrame:
    """Timeout in seconds per (page, action); the last line of an action counts."""
    rows = lines.select(
        "page", "line_no", px.timeout_action(F.col("text")).alias("action"), px.timeout_seconds(F.col("text")).alias("seconds")
    ).where("action IS NOT NULL AND seconds IS NOT NULL")
    return rows.groupBy("page", "action").agg(
        F.max("line_no").alias("line_no"), F.max_by("seconds", "line_no").alias("seconds")
    )


def timeout_diff(wanted: DataFrame, documented: DataFrame) -> DataFrame:
    """Schema timeouts (page, action, want) that the page lacks or gives otherwise, with the line to write."""
    return (
        wanted.join(documented, ["page", "action"], "left")
        .where("seconds IS NULL OR seconds <> want")
        .select(
            "page", "action", "want", "line_no", F.col("seconds").alias("got"),
            px.timeout_line(F.col("action"), px.timeout_text(F.col("want")), F.col("page")).alias("expected"),
        )
    )


def format_errors(lines: DataFrame) -> DataFrame:
    """List lines that do not have the field format, with the class of error and the mended line."""
    text = F.col("text")
    field = text.rlike(px.FIELD)
    wrong_mark = field & text.rlike(px.INCORRECT_MARK) & ~px.is_block_field(text)
    error = (
        F.when(wrong_mark, "incorrect_block_mark")
        .when(px.trimmed(text) == "*", "empty_marker")
        .when(text.startswith("* ~>"), "starred_note")
        .when(~field, "format")
    )
    fixed = (
        F.when(F.col("error") == "starred_note", F.substr("text", F.lit(3)))
        .when(F.col("error") == "incorrect_block_mark", F.regexp_replace("text", px.INCORRECT_MARK, ""))
        .when(F.col("error") == "empty_marker", "")
        .otherwise(text)
    )
    # exploding the one error keeps its patterns from being tested again in a filter
    found = lines.where(text.startswith("*")).select("*", F.explode(F.array_compact(F.array(error))).alias("error"))
    return found.withColumn("fixed", fixed)


def duplicate_fields(fields: DataFrame) -> DataFrame:
    """Fields that a block (page, block) lists more than once; the last line wins."""
    return (
        fields.groupBy("page", "block", "name")
        .agg(F.max("line_no").alias("line_no"), F.count("*").alias("times"))
        .where("times > 1")
        .withColumn("message", F.format_string("duplicate field `%s` in block %s", "name", "block"))
    )


def _on_ways(edges: DataFrame) -> DataFrame:
    """Edges whose blocks all have a way in and a way out, written; others lie on no cycle."""
    while True:
        inner = edges.join(
            edges.select("page", F.col("child").alias("block")).distinct(), ["page", "block"], "left_semi"
        ).join(edges.select("page", F.col("block").alias("child")).distinct(), ["page", "child"], "left_semi")
        kept = materialise(inner.select("page", "block", "child"), "blocks")
        same = kept.count() == edges.count()
        release(edges)
        if same:
            return kept
        edges = kept


def _least_origins(edges: DataFrame) -> DataFrame:
    """The least block (label) that leads to each block (page, node), itself included; grown one edge a round."""
    labels = materialise(
        edges.select("page", F.col("block").alias("node")).distinct().withColumn("label", F.col("node")), "labels"
    )
    while True:
        led = edges.join(labels.withColumnRenamed("node", "block"), ["page", "block"]).select(
            "page", F.col("child").alias("node"), "label", F.lit(None).cast("string").alias("old")
        )
        grown = labels.withColumn("old", F.col("label")).unionByName(led).groupBy("page", "node").agg(
            F.min("label").alias("label"), F.max("old").alias("old")
        )
        next_labels = materialise(grown, "labels")
        release(labels)
        if next_labels.where("label < old").isEmpty():
            return next_labels.drop("old")
        labels = _dropping(next_labels, "old")


def _dropping(table: DataFrame, column: str) -> DataFrame:
    """A written table without a column, still to be released."""
    out = table.drop(column)
    out._written = table._written
    return out


def circular_blocks(edges: DataFrame) -> DataFrame:
    """First block (least name) of each page that contains itself at any depth.

    ``edges`` has (page, block, child). Blocks without a way in or out go first, so pages
    without a cycle are done with. Then each block takes the least block that leads to it: all
    blocks of a cycle take the same, and a block that one of its followers takes is on a cycle, the
    least of those it takes. Such followers go together, other origins go alone, and the rest is
    looked through again. State is a row a block, never a pair of blocks.
    """
    spark = edges.sparkSession
    edges = materialise(edges.select("page", "block", "child").distinct(), "blocks")
    folder, number = scratch_path(spark, "cycles"), 0
    schema = edges.select("page", "block").schema
    while True:
        edges = _on_ways(edges)
        labels = _least_origins(edges)
        closing = edges.join(labels.withColumnRenamed("node", "block"), ["page", "block"]).where("label = child")
        closing.select("page", F.col("child").alias("block")).distinct().write.parquet(f"{folder}/round={number}")
        number += 1
        if edges.isEmpty():
            return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder).groupBy("page").agg(F.min("block").alias("block"))
        cycles = spark.read.schema(schema).parquet(f"{folder}/round={number - 1}").withColumnRenamed("block", "label")
        gone = labels.join(cycles, ["page", "label"], "left_semi").unionByName(labels.where("node = label").select("page", "label", "node"))
        gone = gone.select("page", "node").distinct()
        left = edges.join(gone.withColumnRenamed("node", "block"), ["page", "block"], "left_anti")
        left = left.join(gone.withColumnRenamed("node", "child"), ["page", "child"], "left_anti")
        rest = materialise(left.select("page", "block", "child"), "blocks")
        release(edges)
        edges = rest


def missing_pages(resources: DataFrame, pages: DataFrame) -> DataFrame:
    """Resources (resource, deprecated) without a page; deprecated ones are marked to skip."""
    return resources.join(pages.select("resource").distinct(), "resource", "left_anti").select(
        "resource", F.format_string("%s has no document", "resource").alias("message"), F.col("deprecated").alias("skip")
    )


def skip_rules(findings: DataFrame, entries: DataFrame, patterns: list[str]) -> DataFrame:
    """Findings (resource, path) that no skip entry covers.

    An entry is ``resource``, ``resource.path``, ``resource.*`` or ``all.leaf``.
    ``patterns`` are searched for in ``resource.path``. Entries are cut at each of their
    dots, so that one join by resource answers the first three forms, and one by leaf the last.
    """
    listed = entries.select("entry").distinct()
    parts = F.split("entry", r"\.")
    cut = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(
            F.array_join(F.slice(parts, 1, i), ".").alias("head"),
            F.when(i < F.size(parts), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")).alias("rest"),
        ),
    )
    by_resource = listed.select(F.inline(cut)).distinct()
    leaves = listed.where(F.col("entry").startswith("all.")).select(F.expr("substring(entry, 5)").alias("skipped_leaf"))
    out = findings
    for pattern in patterns:
        out = out.where(~F.concat_ws(".", "resource", "path").rlike(pattern))
    covers = F.col("rest").isNull() | (F.col("rest") == "*") | (F.col("rest") == F.col("path"))
    out = out.join(by_resource, (F.col("resource") == F.col("head")) & covers, "left_anti")
    return out.join(leaves, _leaf("path") == F.col("skipped_leaf"), "left_anti")


CLASSES = ("cross_check", "possible_values", "required", "default", "timeout", "force_new")


def lint_summary(findings: DataFrame) -> DataFrame:
    """Issues, resources with issues, and counts per class; skipped ones are counted apart.

    ``findings`` has (resource, class, skip). Folded per resource first, so the
    distinct count costs no second copy of the rows.
    """
    counts = [F.count(F.when(~F.col("skip") & (F.col("class") == c), 1)).alias(c) for c in CLASSES]
    per_resource = findings.groupBy("resource").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("skip"), 1)).alias("skipped"), *counts
    )
    total = {"n": "issues", "skipped": "skipped", **{c: c for c in CLASSES}}
    return per_resource.agg(
        F.count("*").alias("resources"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in total.items()),
        F.coalesce(F.bool_or(F.col("n") > F.col("skipped")), F.lit(False)).alias("has_diff"),
    )


FIXES = ("required", "default", "force_new", "misspelling", "timeout")


def fix_lines(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """Apply fixes (page, line_no, seq, kind, arg, arg2) to lines, and end each mended line.

    The few fixes of a line are folded in order; other lines pass through.
    """
    per_line = fixes.groupBy("page", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "arg", "arg2"))).alias("fixes")
    )

    def step(line: Column, fix: Column) -> Column:
        arg, arg2 = fix["arg"], fix["arg2"]
        code = [F.concat(F.lit("`"), a, F.lit("`")) for a in (arg, F.substring_index(arg2, ".", -1))]
        mended = (
            F.when(fix["kind"] == "required", px.fix_required(line, arg))
            .when(fix["kind"] == "default", px.fix_default(line, arg))
            .when(fix["kind"] == "force_new", px.fix_force_new(line, arg == "true"))
            .when(fix["kind"] == "misspelling", F.replace(line, code[0], code[1]))
            .when(fix["kind"] == "timeout", px.fix_timeout(line, arg.try_cast("long")))
            .otherwise(line)
        )
        # timeout lines are written whole and get no full stop
        return F.when(fix["kind"] == "timeout", mended).otherwise(px.with_full_stop(mended))

    mended = F.aggregate("fixes", F.col("text"), step)
    return lines.join(per_line, ["page", "line_no"], "left").select(
        "page", "line_no", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(mended).alias("text")
    )


def note_format(lines: DataFrame) -> DataFrame:
    """Note lines that are not in the expected format, and how they should read."""
    return lines.withColumn("expected", px.expected_note(F.col("text"))).where(
        "expected IS NOT NULL AND expected <> text"
    )


def timeouts_in_crud_order(lines: DataFrame) -> DataFrame:
    """Timeout lines whose text must change so that actions stand in CRUD order.

    Of each page at most four lines take part, one per action.
    """
    action = F.lower(F.regexp_extract("text", px.TIMEOUT_LINE, 1))
    rank = F.array_position(F.array(*(F.lit(a) for a in px.TIMEOUT_ACTIONS)), action)
    found = (
        lines.where(F.col("text").rlike(px.TIMEOUT_LINE))
        .select("page", "line_no", "text", rank.alias("rank"))
        .where("rank > 0")
        .groupBy("page", "rank")
        .agg(F.max("line_no").alias("line_no"), F.max_by("text", "line_no").alias("text"))
    )
    pages = found.groupBy("page").agg(
        F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("by_rank"),
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("by_line"),
    )
    return (
        pages.where(F.size("by_rank") > 1)
        .select("page", F.explode(F.arrays_zip("by_line", "by_rank")).alias("z"))
        .select("page", "z.by_line.line_no", F.col("z.by_line.text").alias("text"), F.col("z.by_rank.text").alias("expected"))
        .where("text <> expected")
    )


def expected_timeout_lines(timeouts: DataFrame) -> DataFrame:
    """Line that a page should have for each timeout (page, action, minutes, subject)."""
    return timeouts.select(
        "page", "action",
        px.timeout_line(F.col("action"), px.duration_text(F.col("minutes")), F.col("subject"), stop="").alias("line"),
    )


def heading_rules(section_rows: DataFrame, names: DataFrame) -> DataFrame:
    """Headings that differ from the expected title, arguments and attributes headings.

    ``names`` has (page, name, page_type).
    """
    title = F.when(F.col("page_type") == "data source", F.concat(F.lit("Data Source: "), F.col("name"))).otherwise(F.col("name"))
    rules = F.create_map(*(F.lit(x) for x in ("title", "S003", "arguments", "S004", "attributes", "S005")))
    expected = (
        F.when(F.col("section_type") == "title", title)
        .when(F.col("section_type") == "arguments", ARGUMENTS_HEADING)
        .when(F.col("section_type") == "attributes", ATTRIBUTES_HEADING)
    )
    return (
        section_rows.join(names, "page")
        .select("page", "line_no", F.try_element_at(rules, "section_type").alias("rule"), "heading", expected.alias("expected"))
        .where("expected IS NOT NULL AND expected <> heading")
    )


def api_section(uses: DataFrame) -> DataFrame:
    """One text line per (resource, api) with its distinct versions."""
    versions = F.array_join(F.sort_array(F.collect_set("version")), ", ")
    return (
        uses.groupBy("resource", "api")
        .agg(versions.alias("versions"))
        .select("resource", "api", F.format_string("* `%s` - %s", "api", "versions").alias("line"))
    )


def rule_exceptions(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Findings (page_type, name, rule) without those excepted by (target, rule).

    A target is the prefix d, e or r of the page type, a dot, and the name.
    """
    prefix = (
        F.when(F.col("page_type") == "data source", "d").when(F.col("page_type") == "ephemeral", "e").otherwise("r")
    )
    return (
        findings.withColumn("target", F.concat_ws(".", prefix, "name"))
        .join(exceptions.select("target", "rule").distinct(), ["target", "rule"], "left_anti")
        .drop("target")
    )


# Order of sections and of the kinds of entry inside them. How an
# entry shows its kind is inferred from its text.
SECTION_ORDER = ("BREAKING CHANGES", "FEATURES", "ENHANCEMENTS", "BUG FIXES")
ENTRY_KINDS = {
    "FEATURES": (("actions", "New Action"), ("list_resources", "New List Resource"), ("data_sources", "New Data Source")),
    "ENHANCEMENTS": (("dependencies", "* dependencies"), ("provider", "* provider"), ("data_sources", "Data Source:")),
    "BUG FIXES": (("provider", "* provider"), ("data_sources", "Data Source:")),
}
NEW_ENTRY_HEADERS = {"[BUG]": "BUG FIXES", "[ENHANCEMENT]": "ENHANCEMENTS", "[FEATURE]": "FEATURES"}


def changelog_group(entries: DataFrame, key: str, segment: int = 65_536) -> DataFrame:
    """Entries (key, line_no, section, text) with kind and place after grouping.

    Sections, then kinds, then the old order. Entries are ranked inside segments
    of lines, and the sizes of the segments before (one row each) are added, so
    a changelog of any length is ranked by many tasks.
    """
    text = F.col("text")
    kind, rank = F.lit("general"), F.lit(9)
    for section, kinds in ENTRY_KINDS.items():
        for place, (name, mark) in reversed(list(enumerate(kinds))):
            hit = (F.col("section") == section) & F.contains(text, F.lit(mark))
            kind, rank = F.when(hit, name).otherwise(kind), F.when(hit, place).otherwise(rank)
    order = F.array_position(F.array(*(F.lit(s) for s in SECTION_ORDER)), F.col("section"))
    major = ["section_order", "kind_rank", "segment"]
    rows = entries.select(
        key, "line_no", "section", "text", kind.alias("kind"), rank.alias("kind_rank"), order.alias("section_order"),
        F.floor(F.col("line_no") / segment).alias("segment"),
    )
    before = Window.partitionBy(key).orderBy(*major).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(key, *major).agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy(key, *major).orderBy("line_no")
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(offsets, [key, *major])
        .select(key, "line_no", "section", "text", "kind", (F.col("offset") + F.col("rank")).cast("int").alias("place"))
    )


def place_new_entries(lines: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Line after which each new entry goes, by its mark, else an error.

    The first line that starts with the header counts.
    """
    header = F.coalesce(*(F.when(F.col("entry").startswith(m), F.lit(h)) for m, h in NEW_ENTRY_HEADERS.items()))
    heads = F.coalesce(*(F.when(F.col("text").startswith(h), F.lit(h)) for h in NEW_ENTRY_HEADERS.values()))
    first = (
        lines.select(key, "line_no", heads.alias("header")).where("header IS NOT NULL")
        .groupBy(key, "header").agg(F.min("line_no").alias("after_line"))
    )
    return entries.withColumn("header", header).join(first, [key, "header"], "left").withColumn(
        "error",
        F.when(F.col("header").isNull(), "entry has no known mark").when(F.col("after_line").isNull(), "header not found"),
    )
