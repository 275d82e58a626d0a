"""URL filter: rules first, then the ratio of two character language models; DataFrames only.

1. Host and path of each url; the longest rule that fits its host and path gives the verdict.
2. The urls that rules allow and those that they block train one variable-order Markov model
   each: counts of all character runs up to ``ORDER`` characters over every such row, smoothed
   from the shortest context up (Witten and Bell), as probabilities of a character after its
   context.  Runs of urls to be scored that a model has not seen are in its table with a count of
   zero, so they get their context's back-off weight.  All runs stay, in written tables.
3. A url's score is the mean over its characters of log P(allowed) - log P(blocked).  A fifth of
   the ruled urls stays out of the counts, and the cut with the best balanced accuracy on them
   decides the rest.

Urls are counted and scored once per distinct host and path.  The shuffles are partial sums, joins
of distinct runs, and one small row per character of a scored url, dealt by its run; runs that
make up more than a ``HOT``-th of these characters (so fewer than ``HOT`` runs) are broadcast
instead, which changes no score.

Urls of any length are cut into chunks of ``CHUNK`` characters before their runs are listed.

Defined cases: null urls, and urls without ``://``, have empty host and path; they are judged by
the model like others.  Without any ruled url of both kinds scores and cut are 0 and the verdict
is allow.  Rows are independent of each other, so ties, repeats, null ids and extra columns
change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_jobs.llm.common import keep

ORDER = 5
#: Marks before the first and after the last character.
OPEN, SHUT = "\x02", "\x03"
#: Characters that a model takes to be possible.
ALPHABET = 256
#: Characters of a chunk, in which runs are looked up.
CHUNK = 64
#: A run is hot from this part of all scored characters on.
HOT = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule (host and start of path) that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _places(texts: DataFrame) -> DataFrame:
    """One row per character after the opening mark, with ``run``: the last ``ORDER`` characters up
    to it, marks included, or fewer at the start.

    Texts are first cut into chunks, each with the last characters of the one before: a run is
    looked up in its chunk, so that the work grows with a text's length and not with its square."""
    marked = F.concat(F.lit(OPEN), "text", F.lit(SHUT))

    def joined(chunks: Column) -> Column:
        def one(chunk: Column, k: Column) -> Column:
            before = F.when(k > 0, F.right(F.get(chunks, k - 1), F.lit(ORDER - 1))).otherwise("")
            return F.struct(F.concat(before, chunk).alias("chunk"), F.when(k > 0, ORDER).otherwise(2).alias("first"))

        return F.transform(chunks, one)

    pieces = F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    cut = texts.select(*[c for c in texts.columns if c != "text"], F.inline(F.flatten(F.transform(F.array(pieces), joined))))
    placed = cut.withColumn("at", F.explode(F.sequence(F.col("first"), F.char_length("chunk"))))
    run = F.expr(f"substring(chunk, greatest(at - {ORDER - 1}, 1), least(at, {ORDER}))")
    return placed.withColumn("run", run).drop("chunk", "first", "at")


def train(texts: DataFrame) -> DataFrame:
    """(run, often, ratio) of the longest runs of distinct texts (text, allow, block, scored):
    how often scored texts have it, and the log ratio of its last character after the others.
    ``allow`` and ``block`` are how many rows of each kind train the models with the text."""
    sides = ("allow", "block")
    ends = keep(
        _places(texts.select("text", *sides, F.col("scored").cast("long").alias("often"))).groupBy("run").agg(*[F.sum(c).alias(c) for c in (*sides, "often")]),
        "url-ends",
    )
    length = F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("n")
    counts = keep(
        ends.select("run", *sides, length).groupBy("n", F.expr("right(run, n)").alias("run")).agg(*[F.sum(s).alias(s) for s in sides]),
        "url-runs",
    )
    context = F.expr("substring(run, 1, n - 1)").alias("context")
    contexts = counts.groupBy("n", context).agg(*[F.sum(s).alias(f"{s}_sum") for s in sides], *[F.count_if(F.col(s) > 0).alias(f"{s}_kinds") for s in sides])
    known = keep(counts.select("n", "run", context, *sides).join(contexts, ["n", "context"]), "url-known")
    lower, done = None, []
    for n in range(1, ORDER + 1):
        here = known.filter(F.col("n") == n)
        if lower is None:
            here = here.withColumns({f"{s}_less": F.lit(1.0 / ALPHABET) for s in sides})
        else:
            here = here.join(lower.withColumnRenamed("run", "shorter"), F.expr("substring(run, 2)") == F.col("shorter")).drop("shorter")
        chance = {
            s: F.when(F.col(f"{s}_sum") > 0, (F.col(s) + F.col(f"{s}_kinds") * F.col(f"{s}_less")) / (F.col(f"{s}_sum") + F.col(f"{s}_kinds"))).otherwise(F.col(f"{s}_less"))
            for s in sides
        }
        here = keep(here.select("run", *[c.alias(s) for s, c in chance.items()]), "url-chances")
        done.append(here.select("run", (F.log("allow") - F.log("block")).alias("ratio")))
        lower = here.select("run", *[F.col(s).alias(f"{s}_less") for s in sides])
    return ends.select("run", "often").join(reduce(DataFrame.unionByName, done), "run")


def score(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, score) of distinct texts (key, text) whose runs are all in the model."""
    total = model.agg(F.sum("often")).first()[0] or 0
    hot = model.filter(F.col("often") * HOT > total).select("run", F.col("ratio").alias("hot"))
    places = _places(texts).join(F.broadcast(hot), "run", "left")
    rest = places.filter("hot IS NULL").select("key", "run").join(model.select("run", "ratio"), "run")
    sums = places.filter("hot IS NOT NULL").select("key", F.col("hot").alias("ratio")).unionByName(rest.select("key", "ratio")).groupBy("key").agg(F.sum("ratio").alias("ratio"))
    return texts.join(sums, "key").select("text", F.round(F.col("ratio") / (F.char_length("text") + 1), 9).alias("score"))


def best_cut(scored: DataFrame, width: float = 0.01, most: float = 20.0) -> float:
    """Score from which to allow, by balanced accuracy on (score, allowed): from a histogram of
    ``2 * most / width`` bins, whatever the data."""
    bin_ = F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.col("score"))) / width).cast("long")
    bins = sorted(scored.groupBy(bin_.alias("bin")).agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")).collect())
    n_allow, n_block = sum(r.a for r in bins), sum(r.b for r in bins)
    if not n_allow or not n_block:
        return 0.0
    best, cut, a, b = -1.0, 0.0, n_allow, 0
    for r in bins:
        if (now := a / n_allow + b / n_block) > best:
            best, cut = now, r.bin * width
        a, b = a - r.a, b + r.b
    return cut


def judge(df: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``df``: id, host, path, rule, score, verdict (allow or block).

    ``rules``: verdict by ``host/path`` pattern."""
    host, path = host_and_path(F.col("url"))
    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), list(rules))).withColumn("text", F.concat("host", "path"))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(rules[r])), rules, F).otherwise(F.lit(None).cast("string"))
    urls = urls.withColumn("ruled", by_rule)
    held_out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    kind = [F.count_if(F.col("ruled") == v).alias(v) for v in ("allow", "block")]
    known = urls.groupBy("text").agg(*kind, F.count_if(F.col("ruled").isNull()).alias("open"))
    known = keep(known.withColumns({"key": F.monotonically_increasing_id(), "held": held_out & (F.col("allow") + F.col("block") > 0)}), "url-texts")
    scored = (F.col("open") > 0) | F.col("held")
    trained = {v: F.when(F.col("held"), 0).otherwise(F.col(v)) for v in ("allow", "block")}
    model = keep(train(known.select("text", *[c.alias(v) for v, c in trained.items()], scored.alias("scored"))), "url-model")
    scores = keep(score(known.filter(scored).select("key", "text"), model), "url-scores")
    held = known.filter("held").select("text", F.explode(F.array_compact(F.array(F.when(F.col("allow") > 0, True), F.when(F.col("block") > 0, False)))).alias("allowed"))
    cut = best_cut(scores.join(held, "text"))
    open_ = urls.filter("rule IS NULL").join(scores, "text", "left").withColumn("verdict", F.when(F.coalesce("score", F.lit(0.0)) >= cut, "allow").otherwise("block"))
    ruled = urls.filter("rule IS NOT NULL").withColumns({"score": F.lit(None).cast("double"), "verdict": F.col("ruled")})
    return ruled.unionByName(open_).select("id", "host", "path", "rule", "score", "verdict")
