"""Operator 5, URL filters by association rules.

Explicit rules come first: a rule is host/path, it fits its host and all subdomains where the url's
path starts with the rule's, and the longest fitting rule decides. The other urls are judged by mined
rules: urls with a verdict (an explicit rule's, else the `labels` row of the same id: quality 0 or toxic
blocks) become transactions of url tokens plus the verdict, Spark's FP-growth mines them, and
combinations that imply `block` with enough support and confidence are kept, without those that a
shorter kept rule already covers. A combination that only one explicit rule's urls bear out would carry that rule to hosts
it wasn't written for, so a mined rule needs evidence from `labels` or from two explicit rules at least. An inverted index files each rule under its rarest token; a url looks up
only the rules filed under tokens it has, and a rule matches when the url has all its tokens.

FP-growth gets all frequent tokens of each url. Tokens that occur in the very same labelled urls (the words of
one template) are one item to it: each has the other's counts, so a rule holds with any of them, and a url
matches a rule when it has one token of each of its items.

Tokens leave numbers out, so many urls share one token set; sets are judged once and joined back.
Single tokens rarer than the support are dropped before mining, and a url's tokens are a set, so a hot
host only raises counts. The rule table's length is checked before it is broadcast.

Defined results: a null url or one without :// has empty host and path, no rule fits it, and it is allowed
unless mined rules say otherwise; null ids and repeated rows are judged like others; with no labelled
row, or none blocked, nothing is mined and the rest is allowed; other columns ride along, whatever their names; only an older
column `_url` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read

#: The contract's rules, in its order.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BLOCK = "=block"
#: Filed rules with more tokens than this, in all, are joined by shuffle instead of broadcast.
BROADCAST_RULES = 20_000
#: Blocked token sets beyond this number are joined by shuffle instead of broadcast.
BROADCAST_SETS = 200_000
#: Equal transactions that one row stands for, at most, when they are dealt out to FP-growth.
EQUAL = 1024
#: The source of a verdict that comes from `labels`.
LABELS = "=labels"


@dataclass(frozen=True)
class Mining:
    support: float = 0.002
    confidence: float = 0.9
    #: Urls that must bear a rule out, however small the table.
    least: int = 10


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, empty without ://."""
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, at, 1)), F.regexp_extract(u, at, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # longer ones override
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The url's distinct tokens, sorted: host labels, path words, extension, query names and fragment, without numbers."""
    host, path = parts(url)
    u = F.coalesce(url, F.lit(""))
    query, fragment = F.regexp_extract(u, r"\?([^#]*)", 1), F.regexp_extract(u, r"#(.*)$", 1)

    def some(kind: str, of: Column, by: str) -> Column:
        words = F.filter(F.split(of, by), lambda w: (w != "") & ~w.rlike(r"^[0-9]+$"))
        return F.transform(words, lambda w: F.concat(F.lit(kind), w))

    labels = F.concat(some("h:", host, r"[.:-]"), F.transform(F.slice(F.reverse(F.split(host, r"\.")), 1, 1), lambda w: F.concat(F.lit("t:"), w)))
    names = F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1))
    named = F.transform(F.filter(names, lambda w: w != ""), lambda w: F.concat(F.lit("q:"), w))
    return F.array_sort(F.array_distinct(F.concat(labels, some("p:", ascii_lower(path), r"[/._-]"), named, some("f:", fragment, r"[&=]"))))


def mine(labelled: DataFrame, mining: Mining) -> DataFrame:
    """Rules (antecedent array<string>, same array<array<string>>, confidence, support) for blocking, from rows (_t tokens,
    _blocked, _source, _n). `same` holds the tokens that each token of the antecedent stands for, itself among them."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "antecedent array<string>, same array<array<string>>, confidence double, support double")
    n, blocked = labelled.agg(F.sum("_n"), F.sum(F.when(F.col("_blocked"), F.col("_n")))).first()
    if not blocked:
        return empty
    least = max(mining.least, mining.support * n)
    # A token rarer than the support is in no frequent set; its count among the blocked bounds every rule's support.
    frequent = labelled.where("_blocked").select(F.explode("_t").alias("_k"), "_n").groupBy("_k").agg(F.sum("_n").alias("_c")).where(F.col("_c") >= least)
    # Rows without a frequent token still count for the support.
    rows = labelled.withColumn("_row", F.monotonically_increasing_id())
    rows = cut(rows)
    pairs = rows.select("_row", F.explode("_t").alias("_k")).join(frequent, "_k")
    # Tokens of the same rows are one item, told by the number of their rows and two hashes over them.
    seen = pairs.groupBy("_k").agg(F.count(F.lit(1)).alias("_rows"), F.bit_xor(F.xxhash64("_row")).alias("_x"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("_y"))
    items = cut(seen.groupBy("_rows", "_x", "_y").agg(F.sort_array(F.collect_list("_k")).alias("_same")).select(F.col("_same")[0].alias("_item"), "_same"))
    sets = pairs.join(items.select("_item", F.explode("_same").alias("_k")), "_k").groupBy("_row").agg(F.collect_set("_item").alias("_i"))
    lists = rows.join(sets, "_row", "left").select(F.concat(F.coalesce("_i", F.array().cast("array<string>")), F.when(F.col("_blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"), "_n")
    # Equal transactions were counted together; FP-growth wants each. A frequent one is dealt over many tasks first.
    dealt = lists.select("items", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / EQUAL))).alias("_part")).repartition("items", "_part")
    each = dealt.select("items", F.explode(F.sequence(F.lit(1), F.least(F.lit(EQUAL), F.col("_n") - F.col("_part") * EQUAL).cast("int")))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=mining.confidence).fit(each)
    found = model.associationRules.where((F.col("consequent")[0] == BLOCK)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    found = cut(found.where(F.size("antecedent") > 0))
    short, long_ = found.alias("a"), found.alias("b")
    # A rule is redundant if dropping one token leaves a kept rule; chains end at the shortest.
    less = found.select(F.col("antecedent").alias("whole"), F.explode("antecedent").alias("x")).select("whole", F.array_except("whole", F.array("x")).alias("antecedent"))
    covered = less.join(short.select(F.col("a.antecedent").alias("antecedent")), "antecedent").select(F.col("whole").alias("antecedent")).distinct()
    kept = long_.join(covered, "antecedent", "left_anti").select("antecedent", "confidence", "support")
    named = kept.select("antecedent", F.explode("antecedent").alias("_item")).join(items, "_item").groupBy("antecedent").agg(F.collect_list("_same").alias("same"))
    named = cut(kept.join(named, "antecedent").select("antecedent", "same", "confidence", "support"))
    # Whose verdicts bear each rule out.
    bad = labelled.where("_blocked").select("_t", "_source").distinct()
    proof = hits(bad.select("_t").distinct(), named, _counts(bad)).join(bad, "_t").groupBy("antecedent").agg(F.count_distinct("_source").alias("_of"), F.max(F.col("_source") == LABELS).alias("_labels"))
    return named.join(proof.where("_of > 1 or _labels").select("antecedent"), "antecedent", "left_semi")


def _counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("_t").alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_c"))


def hits(sets: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(_t, antecedent) where a token set among `sets` has a token of each item of a rule, by the index of rarest items."""
    items = rules.withColumn("_r", F.monotonically_increasing_id()).select("_r", "antecedent", "same", F.posexplode("same").alias("_g", "_of"))
    counted = items.select("_r", "antecedent", "same", "_g", F.explode("_of").alias("_k")).join(counts, "_k", "left").groupBy("_r", "antecedent", "same", "_g").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_c"))
    filed = counted.groupBy("_r", "antecedent", "same").agg(F.min(F.struct("_c", "_g"))["_g"].alias("_g"))
    filed = cut(filed.select(F.explode(F.get("same", "_g")).alias("_k"), "antecedent", "same"))
    if (filed.agg(F.sum(F.size(F.flatten("same")))).first()[0] or 0) <= BROADCAST_RULES:
        filed = F.broadcast(filed)
    found = sets.select("_t", F.explode("_t").alias("_k")).join(filed, "_k")
    return found.where(F.forall("same", lambda of: F.arrays_overlap(of, "_t"))).select("_t", "antecedent").distinct()


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", id_col: str = "page_id", label_id: str = "doc_id", rules=RULES, mining: Mining = Mining()) -> DataFrame:
    """pages plus a struct `_url`: host, path, rule, verdict."""
    kept = [c for c in pages.columns if c != "_url"]
    host, path = parts(F.col(url))
    rows = pages.select(F.struct(*kept).alias("_row"), F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"), tokens(F.col(url)).alias("_t"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumn("_rule", rule).withColumn("_verdict", verdict)
    marks = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("_bad"))
    known = rows.select("_id", "_t", "_rule", "_verdict").join(marks, "_id", "left").where("_verdict is not null or _bad is not null")
    blocked = F.coalesce(F.col("_verdict") == "block", F.col("_bad"))
    labelled = known.groupBy("_t", blocked.alias("_blocked"), F.coalesce("_rule", F.lit(LABELS)).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    found = cut(mine(cut(labelled), mining))
    sets = rows.where("_verdict is null").select("_t").distinct()
    # A token set is known by two hashes of it: the arrays themselves aren't shuffled with every url.
    two = [F.xxhash64("_t").alias("_a"), F.xxhash64(F.lit(1), "_t").alias("_b")]
    hit = cut(hits(sets, found, _counts(sets)).select("_t").distinct().select(*two, F.lit(True).alias("_hit")))
    if hit.count() <= BROADCAST_SETS:
        hit = F.broadcast(hit)
    out = rows.select("_row", "_host", "_path", "_rule", "_verdict", *two).join(hit, ["_a", "_b"], "left")
    final = F.coalesce("_verdict", F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow")))
    struct = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), final.alias("verdict"))
    return out.select("_row.*", struct.alias("_url"))


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, read(spark, sf_dir, "labels")).select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")
