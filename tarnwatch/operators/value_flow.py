"""Which value reaches which call: definitions and uses from tokens, and reachability over them.

Tokens are cut into statements. `name = ...` defines the name in the block it stands in, with the rest of the statement as
its value; parameters of a function or arrow are defined by the statement that the function stands in. A use takes the
last definition before it in the innermost block that has one. A statement is reached by a mark (a pattern on its text)
if it has the mark itself, or uses what a reached statement defines, over any number of steps.

What this leaves out: properties of objects, values returned across calls, and regular expression literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.operators.reach import reached
from tarnwatch.operators.source_tokens import JS_TOKEN, enclosing, is_space, tokens
from tarnwatch.sources.scratch import written
from tarnwatch.sources.tables import plain_unions


def statements(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Tokens that are not white space or comments: key, pos, token, line, depth, step, blocks (curly brackets open), stmt.
    A statement ends at a semicolon, a curly bracket, or a line's end outside other brackets; of a curly bracket in round
    ones (a function as an argument) the inside belongs to the statement around it until its next semicolon."""
    t = tokens(files, key, JS_TOKEN, content)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    curly = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    t = t.withColumns({"blocks": (F.coalesce(F.sum(curly).over(before), F.lit(0)) - (F.col("token") == "}").cast("int")).cast("int")})
    outside = F.col("depth") == F.col("blocks")
    ends = (F.col("token") == ";") | (F.col("token").isin("{", "}") & outside) | ((F.col("token") == "\n") & outside)
    t = t.withColumn("stmt", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).cast("int"))
    return t.where(~is_space(F.col("token")))


def flow_edges(t: DataFrame, key: str) -> DataFrame:
    """(key, source, target): statements whose definition another statement uses. t: of `statements`."""
    plain_unions(t.sparkSession)
    order = Window.partitionBy(key).orderBy("pos")
    t = t.withColumns({f"next{n or ''}": F.lead("token", n + 1).over(order) for n in range(2)} | {"prev": F.lag("token").over(order), "prev2": F.lag("token", 2).over(order)})
    t = t.withColumns({"after": F.lead("pos").over(order), "after2": F.lead("pos", 2).over(order)})
    word = F.col("token").rlike(r"^[A-Za-z_$]") & ~F.coalesce(F.col("prev") == ".", F.lit(False))
    sets = F.coalesce(F.col("next") == "=", F.lit(False)) | F.coalesce(F.col("next") == "=>", F.lit(False))
    alone = F.when((F.col("next") == "=>") & (F.col("next1") == "{"), F.col("after2"))
    words = t.where(word).withColumns({"sets": sets, "body": alone})
    # Parameters: words in round brackets before an arrow, or after "function" and perhaps a name. They are defined in the
    # curly brackets that follow, if any do. Each closing bracket belongs to the last one opened at its depth.
    body = F.when(F.col("next") == "{", F.col("after")).when(F.col("next1") == "{", F.col("after2"))
    kind = F.when(F.col("token") == "(", F.when((F.col("prev") == "function") | (F.col("prev2") == "function"), 2).otherwise(1)).otherwise(0)
    round_ = t.where("token IN ('(', ')')").select(key, "pos", "depth", kind.alias("kind"), (F.col("next") == "=>").alias("arrow"), body.alias("body"))
    at_depth = Window.partitionBy(key, "depth").orderBy("pos")
    lists = round_.withColumns({"began": F.lag("pos").over(at_depth), "opened": F.lag("kind").over(at_depth)})
    lists = lists.where("kind = 0 AND (arrow AND opened > 0 OR opened = 2)").select(key, "began", F.struct("began", F.col("pos").alias("until"), "body").alias("list"))
    points = words.select(key, F.col("pos").alias("began"), F.lit(None).cast(lists.schema["list"].dataType).alias("list"))
    latest = Window.partitionBy(key).orderBy("began", F.col("list").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = lists.withColumn("asks", F.lit(False)).unionByName(points.withColumn("asks", F.lit(True)))
    inside = both.withColumn("l", F.last("list", ignorenulls=True).over(latest)).where("asks AND began < l.until").select(key, F.col("began").alias("pos"), F.col("l.until").alias("parameter"), F.col("l.body").alias("own"))
    words = words.join(inside, [key, "pos"], "left").withColumns({"sets": F.col("sets") | F.col("parameter").isNotNull(), "body": F.coalesce("own", "body")})

    blocks = t.where("token = '{'").select(key, "pos", F.col("blocks").alias("depth"), F.lit("").alias("name"))
    points = words.select(key, "pos", F.col("blocks").alias("depth"))
    around = enclosing(points, blocks, key).select(key, "pos", "level", F.col("at").alias("block")).unionByName(points.select(key, "pos", F.lit(-1).alias("level"), F.lit(-1).alias("block")))
    placed = words.select(key, "pos", F.col("token").alias("word"), "stmt", "sets", "blocks", "body").join(around, [key, "pos"])
    # Of a definition only its own block counts, or the body it is a parameter of; of a use every block around it.
    defines = placed.where(F.col("sets") & (F.col("level") == F.col("blocks") - 1)).withColumn("block", F.coalesce("body", "block"))
    uses = placed.where("NOT sets")
    both = defines.select(key, "word", "block", "level", "pos", "stmt", F.struct("pos", "stmt").alias("d")).unionByName(uses.select(key, "word", "block", "level", "pos", "stmt", F.lit(None).cast("struct<pos:int,stmt:int>").alias("d")))
    last = Window.partitionBy(key, "word", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("of", F.last("d", ignorenulls=True).over(last)).where("d IS NULL AND of IS NOT NULL")
    force = met.groupBy(key, "pos", "stmt").agg(F.max_by("of", "level").alias("of"))
    return force.where("of.stmt <> stmt").select(key, F.col("of.stmt").alias("source"), F.col("stmt").alias("target")).distinct()


def reaches(files: DataFrame, marks: dict[str, str], key: str = "id", content: str = "content") -> DataFrame:
    """key, stmt, line, text (tokens parted by spaces, so marks have a space wherever tokens meet), marks (of its own text) and reached (marks whose values come to it, its own among them), for
    statements that have or are reached by any. Files without any mark's text are left out
    before they are cut up."""
    text = F.col(content)
    anywhere = reduce(lambda a, b: a | b, [text.rlike(p.replace(" ?", r"\s*+").replace(" ", r"\s*")) for p in marks.values()])
    some = files.where(anywhere).select(key, content)
    t = written(statements(some, key, content), "flow-tokens")
    s = t.groupBy(key, "stmt").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("text"))
    s = written(s.withColumn("marks", F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in marks.items()]))), "flow-statements")
    node = lambda c: F.concat_ws("#", F.col(key).cast("string"), F.col(c).cast("string"))
    edges = flow_edges(t, key).select(node("source").alias("source"), node("target").alias("target"))
    start = s.select(F.explode("marks").alias("mark"), node("stmt").alias("node"))
    found = reached(edges, start.select(F.concat_ws("#", "mark", F.substring_index("node", "#", 1)).alias("origin"), "node"))
    got = found.groupBy("node").agg(F.array_sort(F.collect_set(F.substring_index("origin", "#", 1))).alias("reached"))
    return s.join(got, node("stmt") == got["node"]).select(key, "stmt", "line", "text", "marks", "reached")
