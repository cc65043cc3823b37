"""Problem 3: record shapes that drift from file to file.

Each file of a feed has a fingerprint: its fields and the JSON types of their values. Consecutive files (by written_at,
then file name) are compared. A field that went and one that came are a rename if the migration rules (``RENAMES``) put
their names into one family, or, of those left over, if their values say so: the same types, at least ``ALIKE`` of
``MINIMA`` least hashes in common, and a word in common between the names. The changes become migration steps
(:func:`migrations`), versioned rows of rename, default, cast and drop, and every file's records go through the chain of
steps from its version on to the canonical fields (:func:`pages`). All of it aggregates distinct (file, field, type), combined
map-side, so copies of lines or files change nothing; only fingerprints, a few dozen rows a file, are shuffled.

Defined results: null payloads and payloads that are no valid JSON object carry no fields; a file without a valid
payload has no fields; the first file of a feed has no changes. A key with null values only is a field without types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The migration rules. For each canonical field the other names that a writer may use for it.
RENAMES: dict[str, tuple[str, ...]] = {
    "schema_version": ("schema", "schemaVersion", "version"),
    "book_id": ("book", "bookId"),
    "page_number": ("page", "page_no", "page_num", "pageNumber"),
    "page_type": ("pageType", "page_kind"),
    "warnings": ("warns", "warning_list"),
    "blocks[].id": ("blocks[].block_id", "blocks[].blockId"),
    "blocks[].type": ("blocks[].kind", "blocks[].block_type", "blocks[].blockType"),
    "blocks[].text": ("blocks[].body", "blocks[].content"),
    "blocks[].caption": ("blocks[].captionText", "blocks[].figure_caption", "blocks[].figureCaption"),
    "blocks[].diagram_text": ("blocks[].diagramText", "blocks[].figure_text", "blocks[].labels"),
    "blocks[].confidence": ("blocks[].conf",),
    "blocks[].level": ("blocks[].heading_level", "blocks[].headingLevel"),
}
#: What a missing field is set to (default rules); fields that aren't here default to null.
DEFAULTS = {"schema_version": "structured-ocr/v1", "page_type": "body"}
#: What a field is cast to (cast rules); diagram text as text, array or object becomes lines, warnings a count and a list.
CASTS = {"page_number": "int", "blocks[].level": "int", "blocks[].diagram_text": "lines", "warnings": "list"}
#: Least hashes kept of a field's values in a file, and how many must agree for a rename without a rule.
MINIMA, ALIKE = 4, 3


def family(field: Column) -> Column:
    """The canonical field of a name; for a name without rule, the name without case marks, so that camel and snake case agree."""
    pairs = [F.lit(x) for canonical, names in RENAMES.items() for name in (canonical, *names) for x in (name, canonical)]
    plain = F.concat(F.lit("~"), F.lower(F.regexp_replace(field, "_", "")))
    return F.coalesce(F.element_at(F.create_map(*pairs), field), plain)


def _json_type(variant: str) -> str:
    s = f"schema_of_variant({variant})"
    return f"CASE WHEN {variant} IS NULL OR {s} = 'VOID' THEN NULL WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} LIKE 'OBJECT%' THEN 'object' ELSE 'number' END"


def words_of(field: Column) -> Column:
    """The words of a name in camel or snake case."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(field, r"^blocks\[\]\.", ""), "(?<=[a-z0-9])(?=[A-Z])", "_")), "_"), lambda w: F.length(w) > 2)


def file_fields(files: DataFrame) -> DataFrame:
    """(feed, file_name, field, types, minima) of every file: its fingerprint, one row a field; minima are the least hashes of its values."""
    lines = files.select("feed", "file_name", F.expr("try_parse_json(payload)").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    spark = files.sparkSession
    # Values of scalars only: those of arrays and objects, the longest, say nothing that their types don't.
    hashed = F.expr(f"CASE WHEN {_json_type('value')} IN ('string', 'number', 'boolean') THEN xxhash64(cast(value as string)) END")
    top = lines.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("feed", "file_name", "key", "value")
    named = top.select("feed", "file_name", F.col("key").alias("field"), F.expr(_json_type("value")).alias("type"), hashed.alias("h"))
    blocks = top.where("key = 'blocks' AND schema_of_variant(value) LIKE 'ARRAY%'").select("feed", "file_name", F.col("value").alias("blocks"))
    each = blocks.lateralJoin(spark.tvf.variant_explode(F.col("blocks").outer())).select("feed", "file_name", F.col("value").alias("block")).where("schema_of_variant(block) LIKE 'OBJECT%'")
    inner = each.lateralJoin(spark.tvf.variant_explode(F.col("block").outer())).select("feed", "file_name", F.concat(F.lit("blocks[]."), "key").alias("field"), F.expr(_json_type("value")).alias("type"), hashed.alias("h"))
    least = [F.min(F.col("h").bitwiseXOR(F.xxhash64(F.lit(i)))).alias(f"m{i}") for i in range(MINIMA)]
    each = named.unionByName(inner).groupBy("feed", "file_name", "field").agg(F.array_sort(F.collect_set("type")).alias("types"), *least)
    return each.select("feed", "file_name", "field", "types", F.array(*[f"m{i}" for i in range(MINIMA)]).alias("minima"))


def file_chain(files: DataFrame) -> DataFrame:
    """(feed, file_name, written_at, version, prev_file): the files of each feed in order; one small row a file."""
    names = files.groupBy("feed", "file_name").agg(F.min("written_at").alias("written_at"))
    w = Window.partitionBy("feed").orderBy("written_at", "file_name")
    return names.select("feed", "file_name", "written_at", F.row_number().over(w).alias("version"), F.lag("file_name").over(w).alias("prev_file"))


def changes(files: DataFrame) -> DataFrame:
    """(feed, file_name, change, field, new_field, types): what each file changed against the one before it, and the types after it."""
    fields = file_fields(files)
    steps = file_chain(files).where("prev_file IS NOT NULL").select("feed", "file_name", "prev_file")
    now = fields.join(steps.select("feed", "file_name"), ["feed", "file_name"])
    before = fields.withColumnRenamed("file_name", "prev_file").join(steps, ["feed", "prev_file"]).select("feed", "file_name", "field", F.col("types").alias("old_types"), F.col("minima").alias("old_minima"))
    both = now.join(before, ["feed", "file_name", "field"], "full_outer")
    changed = both.select(
        "feed", "file_name", "field", "types", "old_types", "minima", "old_minima", family(F.col("field")).alias("family"),
        F.when(F.col("old_types").isNull(), "added").when(F.col("types").isNull(), "removed").when(F.col("types") != F.col("old_types"), "type_changed").alias("change"),
    ).where("change IS NOT NULL")
    # A family with one field gone and one come is a rename; with more, they pair in the order of their names.
    w = Window.partitionBy("feed", "file_name", "family", "change").orderBy("field")
    ranked = changed.withColumn("k", F.row_number().over(w))
    pair = Window.partitionBy("feed", "file_name", "family", "k")
    side = lambda change, *names: F.max(F.when(F.col("change") == change, F.struct(*names))).over(pair)
    moved = F.col("change") != "type_changed"
    paired = ranked.select("*", F.when(moved, side("removed", "field", "old_types")).alias("gone"), F.when(moved, side("added", "field", "types")).alias("come"))
    # Of those left over, the values of a file's removed and added fields are compared; they are few, and each has one partner at most.
    a_file = Window.partitionBy("feed", "file_name")
    single = F.col("gone").isNull() | F.col("come").isNull()
    left = lambda change, types, minima: F.collect_list(F.when(single & (F.col("change") == change), F.struct("field", F.col(types).alias("types"), F.col(minima).alias("minima"), words_of(F.col("field")).alias("words")))).over(a_file)
    open_ = paired.select("*", left("removed", "old_types", "old_minima").alias("all_gone"), left("added", "types", "minima").alias("all_come"))
    common = lambda x, y: F.size(F.filter(F.zip_with(x["minima"], y["minima"], lambda p, q: F.coalesce(p == q, F.lit(False))), lambda same: same))
    likely = lambda x, y: (x["types"] == y["types"]) & (F.size(x["types"]) > 0) & (common(x, y) >= ALIKE) & F.arrays_overlap(x["words"], y["words"])
    partner = lambda others, me: F.array_sort(F.transform(F.filter(others, lambda o: likely(o, me)), lambda o: F.struct((-common(o, me)).alias("n"), o["field"].alias("field"), o["types"].alias("types"))))
    first = lambda a: F.get(a, F.lit(0))
    me = lambda types, minima: F.struct("field", F.col(types).alias("types"), F.col(minima).alias("minima"), words_of(F.col("field")).alias("words"))
    best_of = lambda mine, theirs: F.transform(mine, lambda x: F.struct(x["field"].alias("field"), first(partner(theirs, x)).alias("best")))
    chosen = open_.select("*", best_of(F.col("all_gone"), F.col("all_come")).alias("gone_best"), best_of(F.col("all_come"), F.col("all_gone")).alias("come_best"))
    # Both must be the other's best partner.
    mutual = lambda mine, theirs, name: first(F.filter(mine, lambda x: (x["field"] == F.col("field")) & F.exists(theirs, lambda y: (y["field"] == x["best"]["field"]) & (y["best"]["field"] == F.col("field")))))["best"].alias(name)
    by_value = chosen.select("*", F.when(single & (F.col("change") == "removed"), mutual(F.col("gone_best"), F.col("come_best"), "p")).alias("to"), F.when(single & (F.col("change") == "added"), mutual(F.col("come_best"), F.col("gone_best"), "p")).alias("from"))
    gone = F.coalesce("gone", F.when(F.col("from").isNotNull(), F.struct(F.col("from.field").alias("field"), F.col("from.types").alias("old_types"))))
    come = F.coalesce("come", F.when(F.col("to").isNotNull(), F.struct(F.col("to.field").alias("field"), F.col("to.types").alias("types"))))
    done = by_value.select("feed", "file_name", "change", "field", "types", gone.alias("gone"), come.alias("come"))
    row = lambda change, field, new, types: F.struct(F.lit(change).alias("change"), field.alias("field"), new.alias("new_field"), types.alias("types"))
    none = F.array().cast("array<struct<change:string,field:string,new_field:string,types:array<string>>>")
    renamed = F.col("gone").isNotNull() & F.col("come").isNotNull()
    out = (
        F.when(renamed & (F.col("change") == "added"), none)
        .when(
            renamed,
            F.concat(
                F.array(row("renamed", F.col("gone.field"), F.col("come.field"), F.col("come.types"))),
                F.when(F.col("gone.old_types") != F.col("come.types"), F.array(row("type_changed", F.col("come.field"), F.lit(""), F.col("come.types")))).otherwise(none),
            ),
        )
        .otherwise(F.array(F.struct(F.col("change"), F.col("field"), F.lit("").alias("new_field"), F.col("types"))))
    )
    return done.select("feed", "file_name", F.explode(out).alias("c")).select("feed", "file_name", "c.change", "c.field", "c.new_field", "c.types")


def found(files: DataFrame) -> DataFrame:
    """(feed, file_name, change, field, new_field): what each file changed against the one before it."""
    return changes(files).drop("types")


def _rule(field: Column, rules: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[family(field)]


def migrations(files: DataFrame) -> DataFrame:
    """(feed, version, step, op, field, new_field, argument): the steps that lead from each version of a feed to the next.

    ``rename`` takes new_field for field; ``default`` is set for records from before an added field, ``drop`` ends a field
    (its later records take the default), ``cast`` brings a changed type to that of the argument: the canonical one, else text.
    """
    order = {"renamed": "rename", "added": "default", "removed": "drop", "type_changed": "cast"}
    op = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("change")]
    argument = F.when(F.col("change") == "type_changed", F.coalesce(_rule(F.col("field"), CASTS), F.lit("string"))).when(F.col("change").isin("added", "removed"), _rule(F.col("field"), DEFAULTS))
    steps = changes(files).join(file_chain(files).select("feed", "file_name", "version"), ["feed", "file_name"])
    steps = steps.select("feed", F.col("version").cast("long").alias("version"), op.alias("op"), "field", "new_field", argument.alias("argument"))
    place = F.array_position(F.array(*map(F.lit, order.values())), F.col("op"))
    return steps.select("feed", "version", F.row_number().over(Window.partitionBy("feed", "version").orderBy(place, "field", "new_field")).cast("long").alias("step"), "op", "field", "new_field", "argument")


def file_names(files: DataFrame) -> DataFrame:
    """(feed, file_name, names): for each file the map from its field names to the canonical ones, where they differ.

    A rule settles a name at once; any other follows the feed's later rename steps, in order, to the newest name. Steps
    and fields are rows of fingerprints: what is collected is the unruled renames of one feed.
    """
    ruled = F.lit("~") != F.substring(family(F.col("field")), 1, 1)
    steps = migrations(files).where((F.col("op") == "rename") & ~ruled).groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("version", "field", "new_field"))).alias("steps"))
    fields = file_fields(files).select("feed", "file_name", "field").join(file_chain(files).select("feed", "file_name", "version"), ["feed", "file_name"]).join(steps, "feed", "left")
    later = F.filter(F.coalesce("steps", F.array().cast("array<struct<version:bigint,field:string,new_field:string>>")), lambda s: s["version"] > F.col("version"))
    newest = F.aggregate(later, F.col("field"), lambda name, s: F.when(s["field"] == name, s["new_field"]).otherwise(name))
    canonical = F.when(ruled, family(F.col("field"))).otherwise(newest)
    names = fields.select("feed", "file_name", "field", canonical.alias("to")).where("`to` <> field")
    return names.groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "to"))).alias("names"))


def fingerprints(files: DataFrame) -> DataFrame:
    """The versioned fingerprint of each file: its place in the feed and the hash of its sorted fields and types."""
    shape = F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit(":"), F.array_join("types", "+")))), ",")
    prints = file_fields(files).groupBy("feed", "file_name").agg(F.sha2(shape, 256).alias("fingerprint"), F.count("*").alias("n_fields"))
    return file_chain(files).join(prints, ["feed", "file_name"], "left").select("feed", "file_name", F.col("version").cast("long").alias("version"), "fingerprint", F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


def _let(name: str, value: str, body: str) -> str:
    """An expression with a name for a value that it uses more than once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _entries(record: str, prefix: str = "") -> str:
    """The fields of a record under their canonical names, those that had them already first."""
    raw = f"concat('{prefix}', e.key)" if prefix else "e.key"
    own = f"substring(names[{raw}], {len(prefix) + 1})" if prefix else f"names[{raw}]"
    named = f"transform(map_entries(try_variant_get({record}, '$', 'map<string,variant>')), e -> named_struct('same', names[{raw}] IS NULL, 'name', coalesce({own}, e.key), 'value', e.value))"
    return _let("all_of", named, "CASE WHEN forall(all_of, e -> e.same) THEN all_of ELSE concat(filter(all_of, e -> e.same), filter(all_of, e -> NOT e.same)) END")


def _field(name: str, entries: str) -> str:
    """The value of a canonical field, as a variant; null where it is missing or null."""
    return f"get(filter({entries}, e -> e.name = '{name}' AND schema_of_variant(e.value) <> 'VOID'), 0).value"


def _others(entries: str, known: tuple[str, ...]) -> str:
    """The fields beside the known ones, as a map from the canonical name to the value's JSON text; of two of one name the first."""
    names = ", ".join(f"'{n}'" for n in known)
    first = "transform(array_distinct(transform(rest, e -> e.name)), n -> named_struct('name', n, 'json', to_json(get(filter(rest, e -> e.name = n), 0).value)))"
    return _let("rest", f"filter({entries}, e -> e.name NOT IN ({names}))", f"CASE WHEN size(rest) = 0 THEN cast(map() as map<string,string>) ELSE map_from_entries({first}) END")


BLOCK_FIELDS = ("id", "type", "text", "level", "caption", "confidence", "diagram_text")
PAGE_FIELDS = ("schema_version", "book_id", "page_number", "page_type", "warnings", "blocks")


def pages(files: DataFrame) -> DataFrame:
    """One consistent table of all pages: each payload through the rename, default and cast steps of its file.

    Copies of a line, by (file_name, line_no), count once, one with a valid record before one without; lines without a
    valid record are left out. Numbers written as text, with or without leading zeros, are numbers; diagram text as text,
    array or object of lines is lines joined by line feeds; a warning count and a list of warnings both give n_warnings, and
    a list is kept in ``warnings``. Fields without a column of their own are in ``other_fields``, of the page and of each
    block, as JSON text by their newest name.
    """
    valid = "coalesce(schema_of_variant(try_parse_json(payload)) LIKE 'OBJECT%', false)"
    lines = files.groupBy("feed", "file_name", "line_no").agg(F.expr(f"min(struct(NOT {valid} AS bad, payload))").alias("p")).where("NOT p.bad")
    lines = lines.select("feed", "file_name", "line_no", F.expr("parse_json(p.payload)").alias("v"))
    # A row a file; Spark broadcasts it only where its size allows.
    named = lines.join(file_names(files), ["feed", "file_name"], "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))
    top = named.withColumn("en", F.expr(_entries("v")))
    get = lambda f: f"cast({_field(f, 'en')} as string)"
    inner = lambda f: f"cast({_field(f, 'bn')} as string)"
    lines_of = """
      CASE WHEN d IS NULL THEN NULL
           WHEN schema_of_variant(d) LIKE 'ARRAY%' THEN array_join(try_cast(d as array<string>), '\n')
           WHEN schema_of_variant(d) LIKE 'OBJECT%' THEN array_join(try_variant_get(d, '$.lines', 'array<string>'), '\n')
           ELSE cast(d as string) END"""
    block = f"""transform(try_cast({_field("blocks", "en")} as array<variant>), b -> get(transform(array({_entries("b", "blocks[].")}), bn -> named_struct(
        'id', {inner("id")}, 'type', {inner("type")}, 'text', {inner("text")}, 'level', try_cast({inner("level")} as int), 'caption', {inner("caption")}, 'confidence', {inner("confidence")},
        'diagram_text', get(transform(array({_field("diagram_text", "bn")}), d -> {lines_of}), 0),
        'other_fields', {_others("bn", BLOCK_FIELDS)})), 0))"""
    warnings = _field("warnings", "en")
    listed = f"schema_of_variant({warnings}) LIKE 'ARRAY%'"
    part = lambda f: f"""coalesce(try_variant_get(w, '$.{f}', 'string'), {f"CASE WHEN schema_of_variant(w) = 'STRING' THEN cast(w as string) END" if f == "message" else "NULL"})"""
    more = "transform_values(map_filter(try_variant_get(w, '$', 'map<string,variant>'), (k, x) -> k NOT IN ('code', 'message', 'block_id')), (k, x) -> to_json(x))"
    warned = f"""CASE WHEN {listed} THEN transform(try_cast({warnings} as array<variant>), w -> named_struct(
        'code', {part("code")}, 'message', {part("message")}, 'block_id', {part("block_id")}, 'other_fields', {more})) END"""
    return top.selectExpr(
        "feed", "file_name", "line_no", f"coalesce({get('schema_version')}, '{DEFAULTS['schema_version']}') AS schema_version", f"{get('book_id')} AS book_id", f"try_cast({get('page_number')} AS int) AS page_number",
        f"coalesce({get('page_type')}, '{DEFAULTS['page_type']}') AS page_type",
        f"CASE WHEN {listed} THEN size(try_cast({warnings} as array<variant>)) ELSE coalesce(try_cast({warnings} as int), 0) END AS n_warnings",
        f"{warned} AS warnings", f"{block} AS blocks", f"{_others('en', PAGE_FIELDS)} AS other_fields",
    )
