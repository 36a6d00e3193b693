"""Secret scans with DataFrame functions only: candidates by pattern, false positives removed by a random forest.

Candidates are values with the form of a known key, values assigned to names like token or password, private-key blocks,
and long runs with letters and digits. The forest judges a candidate by its length, character transitions, dictionary
coverage, path and neighbouring words. It is trained on labelled findings (native expressions over a range: secrets of
many kinds on the one side; placeholders, digests of commits, UUIDs, paths and names on the other), with numpy on the
driver, and compiled into one expression, so that scanning stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Labelled findings that the forest is trained on, its trees, and their depth.
FINDINGS, TREES, DEPTH = 3000, 15, 5
THRESHOLD = 0.5
MASK = "[SECRET]"

_RUN = "[0-9A-Za-z+/_-]"
#: Forms have no upper bound, so that a value is one candidate however long; possessive quantifiers never go back.
_KNOWN = r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|[sr]k_live_[0-9A-Za-z]{16,}+|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+"
_NAME = r"""(?i:passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|secret[_-]?keys?(?:[_-]base)?|private[_-]?keys?|credentials?|auth|[_-]keys?|[_-]key[_-]base)["']?\s{0,3}(?:=>|:=|=|:)\s{0,3}["']?"""
_ASSIGNED = _NAME + r"""[^\s"'<>,;(){}]{6,}+"""
#: A key block up to its END line, whatever is inside; without one the header fields and long base64 runs after BEGIN.
_BLOCK = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?>(?s:.*?)-----)END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:[\s\\]*+(?:[A-Za-z-]{1,40}+: [^\r\n]*+|n?[0-9A-Za-z+/=]{16,}+))*+(?:[\s\\]*+[0-9A-Za-z+/]{1,15}+={1,2}+)?+)"
)
_LONG = rf"(?<![0-9A-Za-z+/_.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_RUN}{{20,}}+=?=?"
CANDIDATE = f"(?<![0-9A-Za-z_])(?:{_KNOWN})|{_ASSIGNED}|{_BLOCK}|{_LONG}"
#: A cheap test that every text with a candidate passes.
MAYBE = rf"(?i:passw|passphrase|pwd|secret|token|key|credential|auth)|AKIA|_live_|gh[pousr]_|xox|AIza|eyJ|{_RUN}{{20}}"

#: Words of names, placeholders and file paths. Fixed values.
DICTIONARY = "about access account admin agent alias asset auth backup branch build cache change changeme class client cloud commit common config connect content core credential data database debug default demo deploy dev digest docs document domain dummy email enter error example expiration export fake field file folder foo bar format group handler hash hello help here home host html image import index insert item java key lang lib license list local log login main manager master message model module name node note null object option package page param pass password path phrase placeholder plugin port private prod profile project public query random read record release remote replace request reset response resource root sample script secret select server service session setting share site some source src state static string style sub system table target temp template test text the time title token tool type update url user util value version view web word words work your xxx".split()
_WORDS = "(?i)" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
_BENIGN = r"(?i)commit|sha-?\d|sha\b|md5|digest|checksum|uuid|guid|hash|revision|example|sample|placeholder|template|dummy|tree|blob|object|integrity"
_NAMED = r"(?i)passw|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|[_-]key|credential|auth|bearer"
FEATURES = ["length", "transitions", "digits", "distinct", "dictionary", "path", "named", "benign", "known", "hexadecimal", "vowels"]


def value_of(match: Column) -> Column:
    """What a match assigns, or all of it."""
    assigned = F.regexp_extract(match, f"^{_NAME}(.*)$", 1)
    return F.when(F.length(assigned) > 0, assigned).otherwise(match)


def features(match: Column, before: Column, after: Column) -> Column:
    """A struct of numbers for a candidate with the text around it."""
    value = value_of(match)
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda pattern, of=value: F.regexp_count(of, F.lit(pattern)).cast("double")
    lean = F.regexp_replace(value, _WORDS, "")
    near = F.concat(before, match)
    found = [
        size,
        count("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]") / size,
        count("[0-9]") / size,
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.least(size, F.lit(64.0)),
        (size - F.length(lean)) / size,
        F.when(before.rlike(r"[/\\.]$") | after.rlike(r"^(?:[/\\]|\.[a-z])") | value.rlike(r"[/\\][a-z_-]{3,}[/\\.]|\.(?:html?|js|py|md|txt|png|css|json)$"), 1.0).otherwise(0.0),
        F.when(near.rlike(_NAMED), 1.0).otherwise(0.0),
        F.when(near.rlike(_BENIGN), 1.0).otherwise(0.0),
        F.when(value.rlike(f"^(?:{_KNOWN}|-----BEGIN)"), 1.0).otherwise(0.0),
        F.when(value.rlike("^[0-9a-fA-F-]+$"), 1.0).otherwise(0.0),
        count("[aeiouAEIOU]") / size,
    ]
    return F.struct(*(x.alias(name) for x, name in zip(found, FEATURES, strict=True)))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """match, before, after, label: n findings, deterministic, secrets and look-alikes of many kinds."""
    row = spark.range(n).selectExpr("id", "sha2(cast(id as string), 256) AS s", "sha2(concat('b', id), 256) AS t", "base64(unhex(sha2(concat('c', id), 256))) AS b", "cast(id / 20 AS long) AS k")
    mixed = "regexp_replace(b, '[+/=]', 'Q')"
    words = F.array(*map(F.lit, DICTIONARY))
    pick = lambda seed: f"element_at(words, cast(pmod(xxhash64(id, '{seed}'), {len(DICTIONARY)}) AS int) + 1)"
    secrets = [
        "concat('token = \"', substr(s, 1, 40))", "concat('AKIA', upper(substr({m}, 1, 16)))", "concat('password=', substr(s, 1, 12 + cast(k % 12 AS int)))", "concat('api_key: ', substr({m}, 1, 32))",
        "concat('secret_key=\"', substr({m}, 1, 20 + cast(k % 20 AS int)))", "concat('ghp_', substr({m}, 1, 36))", "concat('auth: ', b)", "concat('sk_live_', substr({m}, 1, 24))", "substr(b, 1, 40)", "concat('pwd=', substr({m}, 1, 10), '!', substr(s, 1, 3))",
    ]
    others = [
        "concat('password=', {a})", "concat('token: ', {a}, '-', {b}, '-here')", "substr(s, 1, 40)", "s", "concat(substr(s, 1, 8), '-', substr(s, 9, 4), '-4', substr(s, 14, 3), '-a', substr(s, 18, 3), '-', substr(s, 21, 12))",
        "concat({a}, '/', {b}, '/', {c}, '_', {d}, cast(k AS string))", "concat('secret=', repeat(substr(s, 1, 1), 8 + cast(k % 20 AS int)))", "concat('AKIA', upper({a}), 'EXAMPLE', upper({b}), '123456789')", "concat({a}, initcap({b}), initcap({c}), initcap({d}), 'Handler', cast(k % 9 AS string))", "concat('api_key: your_', {a}, '_', {b}, '_', k % 3)",
    ]
    row = row.withColumn("words", words)
    text = lambda x: x.format(m=mixed, a=pick("a"), b=pick("b"), c=pick("c"), d=pick("d"))
    match = F.lit("")
    for i, x in enumerate(secrets + others):
        match = F.when(F.col("id") % 20 == i, F.expr(text(x))).otherwise(match)
    context = F.when(F.col("id") % 20 == 12, F.expr("element_at(array('commit ', 'objects/', 'revision ', 'tree ', 'index '), cast(k % 5 AS int) + 1)"))
    context = context.when(F.col("id") % 20 == 13, F.expr("element_at(array('sha256 ', 'integrity: ', 'digest ', 'checksum '), cast(k % 4 AS int) + 1)"))
    context = context.when(F.col("id") % 20 == 14, F.expr("element_at(array('uuid ', 'id ', 'guid '), cast(k % 3 AS int) + 1)")).when(F.col("id") % 20 == 15, F.lit("/"))
    context = context.when(F.col("id") % 20 == 8, F.expr("element_at(array('secret ', 'key ', 'bearer '), cast(k % 3 AS int) + 1)")).otherwise(F.lit(""))
    return row.select("id", match.alias("match"), F.concat(F.expr(pick("x")), F.lit(" "), F.expr(pick("y")), F.lit(" "), context).alias("before"), F.lit(" ").alias("after"), F.when(F.col("id") % 20 < 10, 1).otherwise(0).alias("label"))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A tree: the share of secrets, or (feature, limit, tree up to it, tree beyond)."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in rng.choice(x.shape[1], 4, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n, k = cut + 1.0, ones[cut]
        m, j = len(y) - n, ones[-1] - k
        impurity = k * (n - k) / n + j * (m - j) / m
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0]:
            best = impurity[i], int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2)
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 17) -> list:
    rng = np.random.default_rng(seed)
    return [grow(x[rows], y[rows], rng) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def judged(tree, row: Column) -> Column:
    """A tree as an expression over a struct of features."""
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(row[FEATURES[tree[0]]] <= tree[1], judged(tree[2], row)).otherwise(judged(tree[3], row))


def train(spark: SparkSession) -> list:
    rows = labelled_findings(spark).select("id", "label", features(F.col("match"), F.col("before"), F.col("after")).alias("f")).select("id", "label", "f.*").orderBy("id").collect()
    return forest(np.array([[r[name] for name in FEATURES] for r in rows], float), np.array([r.label for r in rows]))


def scan(docs: DataFrame, trees: list | None = None, text: str = "text") -> DataFrame:
    """docs with pieces (the texts between candidates) and findings: for each candidate its match, start (code points
    before it), score and whether it counts as a secret. Null and empty texts have none; repeated rows stay.

    Columns of docs with these names are replaced. Whole texts are searched; nothing is shuffled.
    """
    trees = train(docs.sparkSession) if trees is None else trees
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    maybe = whole.rlike(MAYBE)
    docs = docs.drop("pieces", "findings").withColumn("pieces", F.when(maybe, F.split(whole, CANDIDATE, -1)).otherwise(F.array(whole)))
    matches = F.when(F.size("pieces") > 1, F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("findings", matches)
    # Arrays meet by arrays_zip, never by place inside a function of elements, where they would be made anew for each.
    n = F.size("findings")
    docs = docs.withColumns({"__before": F.slice("pieces", 1, n), "__after": F.slice("pieces", 2, n)})
    starts = F.aggregate(
        F.arrays_zip("__before", "findings"),
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("all")),
        lambda s, x: F.struct((s.n + F.length(x["__before"]) + F.length(x["findings"])).alias("n"), F.array_append(s.all, s.n + F.length(x["__before"])).alias("all")),
        lambda s: s.all,
    )
    docs = docs.withColumn("__start", starts)
    rows = F.transform(
        F.arrays_zip("findings", "__start", "__before", "__after"),
        lambda x: F.struct(x["findings"].alias("match"), x["__start"].alias("start"), features(x["findings"], F.right(x["__before"], F.lit(60)), F.left(x["__after"], F.lit(10))).alias("f")),
    )
    score = lambda r: reduce(lambda a, b: a + b, (judged(t, r.f) for t in trees)) / len(trees)
    scored = F.transform(rows, lambda r: F.struct(r.match.alias("match"), r.start.alias("start"), score(r).alias("score")))
    named = F.transform(scored, lambda r: F.struct(r.match.alias("match"), r.start.alias("start"), r.score.alias("score"), (r.score >= THRESHOLD).alias("secret")))
    return docs.withColumn("findings", F.when(F.size("findings") > 0, named).otherwise(F.array().cast("array<struct<match:string,start:bigint,score:double,secret:boolean>>"))).drop("__before", "__after", "__start")


def redacted(docs: DataFrame, trees: list | None = None, text: str = "text") -> DataFrame:
    """docs with each secret in the text replaced by MASK; other columns and rows stay as they are, null texts null."""
    found = scan(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")), trees)
    clean = F.concat(
        F.get("pieces", F.lit(0)),
        F.array_join(F.zip_with("findings", F.slice("pieces", 2, F.size("findings")), lambda r, after: F.concat(F.when(r.secret, F.lit(MASK)).otherwise(r.match), after)), ""),
    )
    clean = F.when(F.exists("findings", lambda r: r.secret), clean).otherwise(F.col(f"row.{text}"))
    return found.withColumn("row", F.col("row").withField(text, clean)).select("row.*")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).where(F.size("findings") > 0)
    rows = found.select("doc_id", F.explode("findings").alias("f"))
    return rows.select("doc_id", F.col("f.start").alias("start"), F.length("f.match").cast("long").alias("n_chars"), F.sha2(F.col("f.match").cast("binary"), 256).alias("match_sha256"), F.col("f.score").alias("score"), F.col("f.secret").alias("secret"))
