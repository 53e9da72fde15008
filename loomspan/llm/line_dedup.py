"""Lines from recurring templates, dropped from all documents but the first. DataFrame functions only.

The template tree has a fixed depth. A line's first level is its number of tokens, the second its
two leading tokens: together its node. A token with a digit is a variable field from the start, also
as a leading token, if at least half of the line's tokens have a letter and no digit. On the third
level a node's own counts tell its fields: for each place behind the leading tokens, a token stands
for itself if `least` texts of the node have it there, and at least a given part of the node's texts
(a leaf for each of a few parts); else its place is a field. A leaf's template must be made of words
by more than half, one of them behind the leading tokens. The rule is the same for lines of any
length. Lines that have nothing behind two leading tokens, and rows of numbers (lines whose digits
are not masked), have no node; for these, and for all others as well, equal lines are a template.

A template that lines of `least` or more different texts reach is recurring; its lines go, but for
those of the text whose smallest id is least, so that nothing is lost from the corpus and copies of
that text stay copies. Fields without a digit among the two leading tokens are not generalised.

Counting: nodes, tokens and lines that too few texts have are found with pre-aggregated counts and
fall out first; only rows of the others meet in a join, with a written table, so that a frequent
line's rows can be split over tasks. At the end every text is shuffled once, to its list of lost
lines, which is never broadcast. Keys are 64-bit hashes: a wrong drop would need `least` texts
to collide at once.

Shapes of input with a defined result: a null text has no lines and stays null; an empty text is one
blank line, and blank lines are never dropped; texts and lines of any length are parsed whole; a row
with a null id stays as it is and is not counted; rows that share an id and a text are one; rows
that share an id but not a text are separate texts, and of two with the same least id the one with
the smaller hash keeps its lines; an empty table gives no rows; other columns are kept by
`drop_templates` whatever their names are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written
from ._rows import nested, opened, quoted

#: Texts that make a template recurring, and leading tokens that make a node.
LEAST, LEADING = 5, 2
#: Parts of a node's texts that must have a token at its place for it to stay, besides `least` texts.
PARTS = (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
_SPACE = r"[ \t\x0B\f\r]"
_FIELD = r"(?<![^ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*+[0-9][^ \t\x0B\f\r]*+"
#: What lines have that are not yet their tokens joined by one space, with fields masked, besides spaces in a row or at an end.
_ROUGH = r"[0-9\t\x0B\f\r]"
#: A token with a letter; masked fields have none.
_WORD = r"(?<![^ ])[^ \p{L}]*+\p{L}[^ ]*+"


def _tokens(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _worded(line: Column, n: Column) -> Column:
    return 2 * F.regexp_count(line, F.lit(_WORD)) >= n


def _masked(line: Column) -> Column:
    """The tokens of a line joined by one space, those with a digit masked if half of the tokens are words then. Most lines are that already: one search tells."""
    plain = F.trim(F.regexp_replace(line, f"{_SPACE}+", " "))
    masked = F.regexp_replace(plain, _FIELD, "<*>")
    clean = F.when(_worded(masked, _tokens(masked)), masked).otherwise(plain)
    rough = F.rlike(line, F.lit(_ROUGH)) | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(rough, clean).otherwise(line)


def _node() -> Column:
    """The hash of a line's number of tokens and leading tokens; null where nothing is behind those, and for rows of numbers."""
    line, n = F.col("line"), F.col("n")
    return F.when((n > LEADING) & ~F.rlike(line, F.lit("[0-9]")), F.xxhash64(F.lit(-2), n, F.substring_index(line, " ", LEADING)))


def _leaves(parsed: DataFrame, least: int) -> DataFrame:
    """`th, pos, key, id`: leaves with fields at any places behind the leading tokens, and the least id of the text."""
    tokens = parsed.select("th", "pos", "node", F.posexplode(F.split("line", " ")).alias("j", "w")).where((F.col("j") >= LEADING) & (F.col("w") != "<*>"))
    tokens = tokens.select("th", "pos", F.xxhash64("node", "j", "w").alias("h"), F.rlike("w", F.lit(r"\p{L}")).alias("word"))
    frequent = tokens.select("h", "th").distinct().groupBy("h").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    frequent = written(frequent, "frequent")
    # what holds for a line as a whole comes in one row, so that the rows of its tokens are narrow
    lead = F.regexp_count(F.substring_index("line", " ", LEADING), F.lit(_WORD))
    own = parsed.select("th", "pos", F.struct("node", "n", "texts", lead.alias("lead"), "id").alias("own"))
    found = tokens.join(frequent, "h").select("th", "pos", F.struct("h", "f", "word").alias("token"))
    held = own.unionByName(found, allowMissingColumns=True).groupBy("th", "pos").agg(F.min("own").alias("own"), F.collect_set("token").alias("held"))
    held = held.select("th", "pos", "own.*", "held")
    keys = []
    for part in PARTS:
        enough = F.col("texts") * part
        stay = F.filter("held", lambda x: x["f"] >= enough)
        words = F.size(F.filter(stay, lambda x: x["word"]))
        keys.append(F.when((words > 0) & (2 * (F.col("lead") + words) > F.col("n")), F.xxhash64(F.lit(-3), "node", F.array_sort(F.transform(stay, lambda x: x["h"])))))
    return held.select("th", "pos", "id", F.explode(F.array_distinct(F.array(*keys))).alias("key")).where("key is not null")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """`text_hash, gone array<int>`: places (from 0) of the lines to drop, of texts that lose any. Copies of a text lose the same lines."""
    named = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("t")).where("id is not null and t is not null")
    lines = named.select("id", F.xxhash64("t").alias("th"), "t").select("id", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    lines = lines.select("id", "th", "pos", _masked(F.col("line")).alias("line")).where("line <> ''")
    lines = lines.withColumn("n", _tokens(F.col("line")))
    node = _node()
    lines = written(lines.select("id", "th", "pos", F.xxhash64(F.lit(-1), "line").alias("key"), "n", node.alias("node"), F.when(node.isNotNull(), F.col("line")).alias("line")), "lines")
    often = written(lines.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("key"), "often")
    # from here on copies of a text are one row
    equal = written(lines.join(often, "key").groupBy("key", "th", "pos").agg(F.min("id").alias("id")), "equal")
    noded = lines.where("node is not null")
    nodes = noded.select("node", "th").distinct().groupBy("node").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    nodes = written(nodes, "nodes")
    parsed = noded.join(nodes, "node").groupBy("th", "pos").agg(F.min(F.struct("id", "node", "n", "texts", "line")).alias("one"))
    parsed = written(parsed.select("th", "pos", "one.*"), "parsed")
    drop(lines, often, nodes)
    leaves = written(_leaves(parsed, least), "leaves")
    texts = equal.select("key", "th", "id").union(leaves.select("key", "th", "id")).groupBy("key", "th").agg(F.min("id").alias("id"))
    first = F.min(F.struct("id", "th"))
    templates = written(texts.groupBy("key").agg(F.count("*").alias("n"), first.alias("first")).where(F.col("n") >= least).select("key", F.col("first.th").alias("own")), "templates")
    reached = equal.select("key", "th", "pos").union(leaves.select("key", "th", "pos"))
    gone = reached.join(templates, "key").where("th <> own").groupBy("th").agg(F.collect_set("pos").alias("gone"))
    gone = written(gone.withColumnRenamed("th", "text_hash"), "gone")
    drop(equal, templates, parsed, leaves)
    return gone


def _marked(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """`row, id, text, gone`: each row with the places of the lines it loses, null for none."""
    gone = recurring_lines(docs, id_col, text_col, least)
    rows = nested(docs, id_col, text_col).withColumn("text_hash", F.when(F.col("id").isNotNull(), F.xxhash64("text")))
    # the list grows with the input, so the texts are dealt to it at any size: a small run then moves what a large one will
    return rows.join(gone.hint("merge"), "text_hash", "left")


def _rest() -> Column:
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """`docs` with the same columns and rows, its texts without the lines of recurring templates."""
    return opened(_marked(docs, id_col, text_col, least), docs.columns, text_col, _rest())


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of `docs`: `id_col, n_lines, n_dropped, kept_sha256` (null for a null text)."""
    marked = _marked(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col, least)
    lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0)
    return marked.select(F.col("row")[id_col].alias(id_col), lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(_rest(), 256).alias("kept_sha256"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def template_sql(docs: str) -> str:
    """CTEs `gone (doc_id, text, places)` and what they need, in DuckDB's SQL, over a relation with doc_id and text."""
    leaves = " UNION ALL ".join(
        f"""SELECT doc_id, text, pos, 't ' || n || chr(10) || t1 || chr(10) || t2 || chr(10) || string_agg(j || ':' || w, chr(10) ORDER BY j) AS key FROM held WHERE f >= texts * {part}
        GROUP BY doc_id, text, pos, n, t1, t2, lead HAVING count(*) FILTER (word) > 0 AND 2 * (lead + count(*) FILTER (word)) > n"""
        for part in PARTS
    )
    letter = r"'\p{L}'"
    return rf"""
    split_lines AS (SELECT DISTINCT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
        FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    raw AS (SELECT doc_id, text, pos, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS own FROM split_lines),
    masked AS (SELECT *, len(own) AS n, list_transform(own, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS hidden FROM raw),
    tokened AS (SELECT doc_id, text, pos, n, CASE WHEN 2 * len(list_filter(hidden, lambda x: regexp_matches(x, {letter}))) >= n THEN hidden ELSE own END AS tokens FROM masked WHERE n > 0),
    noded AS (SELECT *, tokens[1] AS t1, tokens[2] AS t2, CAST(regexp_matches(tokens[1], {letter}) AS INT) + CAST(regexp_matches(tokens[2], {letter}) AS INT) AS lead
        FROM tokened WHERE n > {LEADING} AND NOT regexp_matches(array_to_string(tokens, ' '), '[0-9]')),
    nodes AS (SELECT n, t1, t2, count(DISTINCT text) AS texts FROM noded GROUP BY ALL HAVING count(DISTINCT text) >= {LEAST}),
    placed AS (SELECT *, tokens[j] AS w FROM (SELECT *, unnest(range({LEADING} + 1, n + 1)) AS j FROM noded JOIN nodes USING (n, t1, t2)) WHERE tokens[j] <> '<*>'),
    frequent AS (SELECT n, t1, t2, j, w, count(DISTINCT text) AS f FROM placed GROUP BY ALL HAVING count(DISTINCT text) >= {LEAST}),
    held AS (SELECT doc_id, text, pos, n, t1, t2, j, w, f, texts, lead, regexp_matches(w, {letter}) AS word FROM placed JOIN frequent USING (n, t1, t2, j, w)),
    leaves AS (SELECT doc_id, text, pos, '- ' || array_to_string(tokens, ' ') AS key FROM tokened UNION ALL {leaves}),
    templates AS (SELECT key, arg_min(text, doc_id) AS own FROM leaves GROUP BY key HAVING count(DISTINCT text) >= {LEAST}),
    gone AS (SELECT doc_id, text, list(DISTINCT pos) AS places FROM leaves JOIN templates USING (key) WHERE text <> own GROUP BY ALL)"""


OP9_SQL = f"""WITH {template_sql("documents")}
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.places), 0) AS BIGINT) AS n_dropped,
    sha256(CASE WHEN g.places IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.places, i - 1)), chr(10)), '') END) AS kept_sha256
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text"""
