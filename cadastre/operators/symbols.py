"""Queries over a symbol index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre.session import materialise, scratch_path

# What an import line, a call, and a struct field look like.
IMPORT_LINE = r'(?m)^[ \t(]*(?:([\w.]+)[ \t]+)?"([^"]+)"'
CALL = r"(?:^|[^.\w])([A-Za-z_]\w*)\("
# tokens of a declaration: raw and quoted texts, comments, words with their dots, line ends, marks
TOKEN = r'`[^`]*`|"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*(?s:.*?)\*/|[\w.]+|\n|[^\s\w]'
STRUCT = r"^\s*(?:type\s+)?\w+(?:\[[^\]]*\])?\s+struct\s*\{"


def symbol_counts(symbols: DataFrame, *keys: str) -> DataFrame:
    """Declarations and lines per combination of ``keys``, with all subtotals."""
    return symbols.cube(*keys).agg(
        F.count("*").alias("declarations"),
        F.sum("loc").alias("loc"),
        F.grouping_id().cast("int").alias("level"),
    )


def explode_imports(symbols: DataFrame) -> DataFrame:
    """One row (path, pos, alias, import_path) per import."""
    found = F.arrays_zip(
        F.regexp_extract_all("import_block", F.lit(IMPORT_LINE), F.lit(1)).alias("alias"),
        F.regexp_extract_all("import_block", F.lit(IMPORT_LINE), F.lit(2)).alias("import_path"),
    )
    return symbols.select("path", F.posexplode(found).alias("pos", "i")).select(
        "path", "pos", F.nullif("i.alias", F.lit("")).alias("alias"), "i.import_path"
    )


def used_imports(symbols: DataFrame) -> DataFrame:
    """Imports whose alias, else last path segment, is used in the declaration.

    Imports are filtered inside their row, so no body is copied per import. A
    plain search for ``ident.`` rejects most of them; only the rest are matched
    as the start of an identifier chain.
    """
    found = F.arrays_zip(
        F.regexp_extract_all("import_block", F.lit(IMPORT_LINE), F.lit(1)).alias("alias"),
        F.regexp_extract_all("import_block", F.lit(IMPORT_LINE), F.lit(2)).alias("import_path"),
    )
    named = F.transform(
        found,
        lambda i: F.struct(
            i["import_path"].alias("import_path"),
            F.coalesce(F.nullif(i["alias"], F.lit("")), F.substring_index(i["import_path"], "/", -1)).alias("used_as"),
        ),
    )
    used = F.filter(
        named,
        lambda i: F.contains("body", F.concat(i["used_as"], F.lit(".")))
        & F.regexp_like("body", F.concat(F.lit(r"(?:^|[^A-Za-z0-9_.])\Q"), i["used_as"], F.lit(r"\E\."))),
    )
    return symbols.select("path", F.inline(used))


def dependency_edges(uses: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges with their weight."""
    return uses.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree and out-degree of every node, from one pass over the edges."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return (
        edges.select(F.inline(ends))
        .groupBy("node")
        .agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    )


def local_call_graph(symbols: DataFrame) -> DataFrame:
    """Edges from a declaration to the functions of its own package that it calls."""
    text = F.replace(
        F.regexp_replace("body", r"^func (?:\([^)]*\) )?\w+", ""), F.lit("("), F.lit("( ")
    )
    calls = symbols.select(
        "package_dir",
        F.col("path").alias("caller"),
        F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)))).alias("name"),
    )
    functions = symbols.where(F.col("kind") == "func").select(
        "package_dir", "name", F.col("path").alias("callee")
    )
    return calls.join(functions, ["package_dir", "name"]).select("caller", "callee")


def reachability(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Every node reached from the entry nodes, with its least depth.

    Breadth-first: each round joins the frontier to the edges and drops nodes
    seen before, which is also the cycle guard. Edges are written once, and the rounds to one
    folder with a subfolder a depth, so the plan of a round is the same however many there were,
    and a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    folder = scratch_path(spark, "reach")
    found = entries.select("node").distinct()
    schema = T.StructType([*found.schema.fields, T.StructField("depth", T.IntegerType(), False)])
    depth = 0
    while True:
        found.write.parquet(f"{folder}/depth={depth}")
        frontier = spark.read.schema(found.schema).parquet(f"{folder}/depth={depth}")
        seen = spark.read.schema(schema).parquet(folder)
        if frontier.isEmpty():
            return seen
        depth += 1
        found = (
            edges.join(frontier, edges.src == frontier.node)
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
        )


def _statements(body: Column) -> Column:
    """The statements of a struct declaration, each a list of tokens: one fold that counts open brackets.

    Depth 0 is before the struct, -1 behind it. A statement ends with its line only at depth
    1, so inline types, functions and their brackets stay in one piece; line ends inside them become
    semicolons. Comments are left out.
    """
    tokens = F.filter(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("//") & ~t.startswith("/*"))
    none = F.array().cast("array<string>")

    def step(s, t):
        depth, words = s["depth"], s["words"]
        opens, closes, line = t.isin("{", "(", "["), t.isin("}", ")", "]"), t == "\n"
        ends = (depth == 1) & (line | closes | (t == ";"))
        deeper = (
            F.when(depth == 0, F.when(t == "{", 1).otherwise(0)).when(depth < 0, depth)
            .when(opens, depth + 1).when(closes, F.when(depth == 1, -1).otherwise(depth - 1)).otherwise(depth)
        )
        last = F.element_at(words, -1)
        words_next = (
            F.when(ends, none).when(depth < 1, words)
            .when(line, F.when(last.isin("{", "(", ";", ","), words).otherwise(F.array_append(words, F.lit(";"))))
            .otherwise(F.array_append(words, t))
        )
        out = F.when(ends & (F.size(words) > 0), F.array_append(s["out"], words)).otherwise(s["out"])
        return F.struct(deeper.cast("int").alias("depth"), words_next.alias("words"), out.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), none.alias("words"), F.array().cast("array<array<string>>").alias("out"))
    return F.when(body.rlike(r"(?m)" + STRUCT), F.aggregate(tokens, start, step, lambda s: s["out"])).otherwise(F.array().cast("array<array<string>>"))


def _type_text(tokens: Column) -> Column:
    """Tokens of a type as it is written."""
    out = F.regexp_replace(tokens, r" ?([\[\]{*]) ?", "$1")
    for pattern, text in ((r" ?;? ?\}", "}"), (r" ([,;)])", "$1"), (r"(?<!\)) \(", "("), (r"\( ", "("), (r"< - ?", "<-")):
        out = F.regexp_replace(out, pattern, text)
    return out


def struct_fields(types: DataFrame) -> DataFrame:
    """Fields of struct declarations (type_name, pos, field, field_type, tags).

    A line of several names is a field each; an embedded type is a field of its own name
    without package, pointer and type arguments; unexported fields are fields as well. A body that
    declares no struct has none.
    """
    def fields(w: Column) -> Column:
        last = F.element_at(w, -1)
        tagged = F.substring(last, 1, 1).isin("`", '"')
        plain = F.array_join(F.when(tagged, F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w), " ")
        tag = F.when(tagged, F.replace(last.substr(F.lit(2), F.length(last) - 2), F.lit('\\"'), F.lit('"')))
        names, rest = (F.regexp_extract(plain, r"^((?:\w+ , )*\w+) (.+)$", i) for i in (1, 2))
        embedded = (names == "") | rest.rlike(r"^\[ [^\]]+ \]$") & ~rest.rlike(r"^\[ \d* \]$")
        own_name = F.regexp_extract(plain, r"^(?:\* )?(?:\w+\.)*(\w+)", 1)
        of_type = _type_text(F.when(embedded, plain).otherwise(rest))
        listed = F.when(embedded, F.array(own_name)).otherwise(F.split(names, " , "))
        return F.transform(listed, lambda name: F.struct(name.alias("field"), of_type.alias("field_type"), tag.alias("tag")))

    def tag(name: str) -> Column:
        return F.nullif(F.regexp_extract("f.tag", name + r':"([^",]*)', 1), F.lit("")).alias(name + "_tag")

    found = F.flatten(F.transform(_statements(F.col("body")), fields))
    return types.select("type_name", F.posexplode(found).alias("pos", "f")).select(
        "type_name", "pos", "f.field", "f.field_type", tag("json"), tag("tfschema"), tag("tfsdk")
    )


def model_tag_check(fields: DataFrame, tag: str = "tfschema_tag") -> DataFrame:
    """Fields without a tag, by dotted path from each root type through list fields.

    A field is reported before the types inside it are; a type already on the
    path is not entered again. Fields are read each round, so they are written once.
    """
    fields = materialise(fields.select("type_name", "field", "field_type", tag), "fields")
    element = F.regexp_extract("field_type", r"^\[\]\*?(\w+)$", 1)
    level = fields.select(
        F.col("type_name").alias("root"), F.col("field").alias("field_path"), tag,
        element.alias("inner"), F.array("type_name").alias("on_path"),
    )
    out = level
    inner_fields = fields.select("type_name", "field", F.col(tag).alias("inner_tag"), element.alias("next_inner"))
    while True:
        level = materialise(
            level.where("inner <> ''")
            .join(inner_fields, F.col("inner") == inner_fields.type_name)
            .where(~F.array_contains("on_path", F.col("type_name")))
            .select(
                "root",
                F.concat_ws(".", "field_path", "field").alias("field_path"),
                F.col("inner_tag").alias(tag),
                F.col("next_inner").alias("inner"),
                F.concat("on_path", F.array("type_name")).alias("on_path"),
            ),
            "tags",
        )
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.where(F.col(tag).isNull()).select("root", "field_path")


def interface_satisfaction(methods: DataFrame, required: list[str]) -> DataFrame:
    """Which receivers have every required method, and which are missing.

    Only required names are gathered, so a group holds at most ``required``.
    """
    wanted = F.array(*(F.lit(m) for m in required))
    have = F.collect_set(F.when(F.col("method").isin(required), F.col("method")))
    return (
        methods.groupBy("receiver")
        .agg(have.alias("have"))
        .select(
            "receiver",
            F.size("have").alias("n_have"),
            F.array_join(F.sort_array(F.array_except(wanted, "have")), ",").alias("missing"),
            (F.size("have") == len(required)).alias("satisfied"),
        )
    )
