"""Secret scans: candidates by a pattern, false positives removed by a random forest.

Native: extraction, features and the forest's votes are SQL expressions inside one
row, so the whole scan is a map without a shuffle, and a text's candidates never
leave its row until they are findings. The forest is MLlib's, trained on a
labelled table of findings with a fixed number of rows that a rule makes (known
key formats, random strings and look-alikes: card and phone numbers, dates,
commit hashes, paths, slugs, identifiers, placeholders); its trees are then
written out as CASE expressions.

A candidate is, behind a secret's name, any value of 6 or more characters without
blanks and quotes; with a known key's prefix, a run of 12 or more letters, digits or
``_+/-``; else such a run of 16 or more with a digit in it, with up to two ``=``
behind. Features: length, kinds of
characters and changes between them, different characters, the share that
dictionary words cover, path signs, and the words next to it.

Null and empty texts have no candidates; whole texts are scanned, however long.
Repeated secrets and rows are findings of their own. Ids stay, nulls too. An empty
table gives an empty result. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import free_name

#: Ends of secrets' names, and what stands between them and the value. Each pair is a look behind of its own: these have one width.
NAMED = "assword asswd assphrase pwd ecret oken api_key apikey api-key API_KEY APIKEY access_key ACCESS_KEY SECRET TOKEN ASSWORD auth earer rivate_key redential redentials".split()
BETWEEN = ["=", ":", ": ", " = ", " : ", '="', "='", ': "', ": '", ' = "', " = '", '": "', "': '", '":"', ":'", ':"']
_BEHIND = "|".join(f"(?<={name}{sign})" for name in [*NAMED] for sign in BETWEEN) + "|" + "|".join(f"(?<={name} )" for name in ("earer", "EARER")) + "|" + "|".join(f"(?<={name} is )" for name in ("assword", "asswd", "assphrase", "ecret", "oken"))
_KNOWN = r"(?=gh[pousr]_|sk_live_|sk_test_|rk_live_|sk-|xox[abp]-|AIza|eyJ|A[KS]IA)"
#: Behind a name any value without blanks or quotes, from 6 characters on; with a known prefix from 12 on; else a run with a digit.
CANDIDATE = (
    r"(?:(?:(?<=[=:\"'])|(?<=[=:] )|(?<=earer )|(?<=EARER )|(?<= is ))(?:" + _BEHIND + r")[^\s\"'`<>]{6,}(?<![.,;:)\]}])"
    r"|(?<![A-Za-z0-9_+/\-])(?:" + _KNOWN + r"[A-Za-z0-9_+/\-]{12,}={0,2}|(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,}={0,2}))"
)
HIDDEN = "[SECRET]"
BEFORE, AFTER = 40, 16
TREES, DEPTH, ROWS = 24, 6, 2400
#: Words whose letters count as covered, names of secrets, and names of things that look like them.
WORDS = "the and tion ing ment able ver with from have this that user name data file path page home list item test best ways make money time date year get set new old site lib local python package version final build report index image photo video music class handler account service config system model value key token secret number order phone street city".split()
NAMES = r"(?i)(passw|secret|token|api.?key|auth|bearer|credential|private|access)"
DECOYS = r"(?i)(commit|sha-?\d|md5|checksum|uuid|guid|order|invoice|card|phone|isbn|doi|version|ticket|example|sample|dummy|placeholder)"
PREFIXES = r"^(AKIA|ASIA|gh[pousr]_|sk_live|sk-|xox[abp]-|AIza|eyJ)"

#: name -> SQL over @c (the candidate), @b and @a (the text before and after).
FEATURES = {
    "n": "length(@c)",
    "digits": "length(regexp_replace(@c, '[^0-9]', '')) / length(@c)",
    "upper": "length(regexp_replace(@c, '[^A-Z]', '')) / length(@c)",
    "lower": "length(regexp_replace(@c, '[^a-z]', '')) / length(@c)",
    "signs": "length(regexp_replace(@c, '[A-Za-z0-9]', '')) / length(@c)",
    "changes": "regexp_count(@c, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])') / length(@c)",
    "unlike": "size(array_distinct(split(@c, ''))) / length(@c)",
    "covered": f"1 - length(regexp_replace(lower(@c), '({'|'.join(WORDS)})', '')) / length(@c)",
    "letters": "array_max(transform(split(@c, '[^A-Za-z]+'), x -> length(x)))",
    "hex": "int(@c rlike '^[0-9a-f]+$')",
    "path": "regexp_count(@c, '/') + int(@b rlike '[/.~]$') + int(@a rlike '^[.][a-z]')",
    "named": f"int(@b rlike '{NAMES}')",
    "assigned": "int(@b rlike '[=:]\\\\s*[\"`]?$')",
    "decoy": f"int(@b rlike '{DECOYS}' or @c rlike '{DECOYS}')".replace("\\d", "[0-9]"),
    "prefix": f"int(@c rlike '{PREFIXES}')",
}


def labelled_findings(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """c, b, a and label of made-up findings, by a rule."""
    hexed = lambda salt, n: f"substr(sha2(concat('{salt}', id), 512), 1, {n})"
    mixed = lambda salt, n: f"substr(translate(base64(unhex(sha2(concat('{salt}', id), 512))), '+/=\\n\\r', 'xyz'), 1, {n})"
    digits = lambda salt, n: f"substr(translate(sha2(concat('{salt}', id), 512), 'abcdef', '482913'), 1, {n})"
    word = lambda k: f"element_at(split('ways make home garden station number report final image street user data north river', ' '), 1 + int(pmod(xxhash64(id, {k}), 14)))"
    some = lambda *x: f"element_at(array({', '.join(x)}), 1 + int(pmod(xxhash64(id, 77), {len(x)})))"
    wide = "int(16 + pmod(xxhash64(id, 5), 32))"
    neutral = f"concat({word(1)}, ' ', {word(2)}, ' ')"
    #: (candidate, before, after, label)
    kinds = [
        (hexed("a", 40), some("'token = \"'", "'secret: '", "'api_key=\"'"), "'\" '", 1),
        (hexed("b", wide), some("'password='", "'passwd: '", "'the password is '"), "' '", 1),
        (f"concat('AKIA', upper({mixed('c', 16)}))", neutral, "' '", 1),
        (f"concat('AKIA', upper({mixed('d', 16)}))", "'aws_access_key_id='", "' '", 1),
        (f"concat('ghp_', {mixed('e', 36)})", some(neutral, "'token: '"), "'\"'", 1),
        (mixed("f", 40), some("'api key: '", "'SECRET_ACCESS_KEY='", "'auth '"), "' '", 1),
        (f"concat('sk_live_', {mixed('g', 24)})", some(neutral, "'key = '"), "' '", 1),
        (f"concat('eyJ', {mixed('h', 57)})", some("'Authorization: Bearer '", neutral), "' '", 1),
        (mixed("i", "int(32 + pmod(xxhash64(id, 6), 24))"), neutral, "' '", 1),
        (f"concat('sk_live_', translate({mixed('w', 24)}, '0123456789', 'qWzKpXvJdR'))", some(neutral, "'key = '"), "' '", 1),
        (f"translate({mixed('z', 'int(8 + pmod(xxhash64(id, 9), 16))')}, '0123456789', 'qWzKpXvJdR')", some("'password='", "'passwd: '", "'secret = '"), "' '", 1),
        (f"concat({mixed('y', 'int(4 + pmod(xxhash64(id, 10), 6))')}, element_at(array('!', '$', '@', '%', '#'), 1 + int(pmod(xxhash64(id, 12), 5))), {mixed('A', 'int(3 + pmod(xxhash64(id, 11), 6))')})", some("'password='", "'password: '", "'token = '"), "' '", 1),
        (some(word(3), f"concat({word(3)}, {word(4)})", f"concat({word(3)}, 's')", "'required'", "'undefined'", "'authentication'", "'changeable'"), some("'password: '", "'token='", "'the secret is '", "'password='"), "' '", 0),
        (digits("j", 16), some(neutral, "'card '", "'phone: '", "'token '"), "' '", 0),
        (f"concat('20', {digits('k', 15)})", some("'order '", neutral, "'time='"), "' '", 0),
        (f"concat_ws('-', {hexed('l', 8)}, {hexed('m', 4)}, {hexed('n', 4)}, {hexed('o', 4)}, {hexed('p', 12)})", some("'uuid: '", neutral, "'id='"), "' '", 0),
        (some(hexed("q", 40), hexed("r", 64), hexed("s", 32)), some("'commit '", "'sha256: '", "'md5 '", "'checksum='"), "' '", 0),
        (f"concat('/usr/lib/python3/', {word(3)}, '/', {word(4)})", some(neutral, "'path='", "'https:/'"), "'.py'", 0),
        (f"concat_ws('-', {word(3)}, '10', {word(4)}, 'to', {word(5)})", some(neutral, "'example.com/'", "'name: '"), "' '", 0),
        (f"concat('get', initcap({word(3)}), initcap({word(4)}), 'V2Handler')", some(neutral, "'class '"), "'('", 0),
        (f"concat('your_', {word(3)}, '_key_here_123')", some("'token = \"'", "'password='"), "'\"'", 0),
        ("concat(repeat(element_at(array('x', '0', 'X', 'a'), 1 + int(id % 4)), 20), '1234')", some("'token = \"'", "'api_key='"), "'\"'", 0),
        (f"concat_ws('-', '+49', {digits('t', 3)}, {digits('u', 4)}, {digits('v', 4)})", some("'phone '", neutral), "' '", 0),
        (f"concat({word(3)}, {word(4)}, {word(5)}, int(id % 90))", neutral, "' '", 0),
    ]
    pick = lambda at: "CASE id % {} {} END".format(len(kinds), " ".join(f"WHEN {k} THEN {kind[at]}" for k, kind in enumerate(kinds)))
    return spark.range(0, rows, 1, 1).selectExpr(f"{pick(0)} AS c", f"{pick(1)} AS b", f"{pick(2)} AS a", f"double({pick(3)}) AS label")


def _features(row: str = "") -> str:
    """The features as one struct's fields; ``row``: where c, b and a stand."""
    return ", ".join(f"'{name}', double({sql.replace('@', row)})" for name, sql in FEATURES.items())


def assembled(rows: DataFrame) -> DataFrame:
    """Labelled findings (c, b, a, label) with their features as one vector."""
    own = rows.selectExpr(f"named_struct({_features()}) AS f", "label").select("f.*", "label")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(own).select("features", "label")


def fitted_forest(spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    learner = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt")
    return learner.fit(assembled(findings if findings is not None else labelled_findings(spark)))


def train_forest(spark: SparkSession) -> str:
    return forest_sql(fitted_forest(spark))


def forest_sql(model: RandomForestClassificationModel) -> str:
    """The forest's probability of a secret as SQL over a struct f of the features: the mean of its leaves' shares, each tree a CASE expression."""
    names = list(FEATURES)

    def tree(node) -> str:
        if node.subtreeDepth() == 0:
            counts = list(node.impurityStats().stats())
            return f"{counts[1] / sum(counts)!r}D"
        split = node.split()
        return f"CASE WHEN f.{names[split.featureIndex()]} <= {split.threshold()!r}D THEN {tree(node.leftChild())} ELSE {tree(node.rightChild())} END"

    shares = [tree(one._call_java("rootNode")) for one in model.trees]
    return f"({' + '.join(f'({v})' for v in shares)}) / {len(shares)}"


def scanned(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: an array of structs (candidate, score, gap), where gap is the text in front; the last one has no candidate."""
    score = train_forest(docs.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    taken, work = [*docs.columns, out], {}
    for name in ("found", "gaps", "rows"):
        work[name] = free_name(f"__{name}", taken)
        taken.append(work[name])
    have = docs.withColumn(work["found"], F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0)))
    have = have.withColumn(work["gaps"], F.when(F.size(work["found"]) > 0, F.split(whole, CANDIDATE, -1)).otherwise(F.array(whole)))
    zipped = f"transform({work['found']}, (c, i) -> named_struct('c', c, 'b', right(element_at({work['gaps']}, i + 1), {BEFORE}), 'a', left(element_at({work['gaps']}, i + 2), {AFTER}), 'gap', element_at({work['gaps']}, i + 1)))"
    have = have.withColumn(work["rows"], F.expr(zipped))
    scored = f"transform(transform({work['rows']}, x -> named_struct('candidate', x.c, 'gap', x.gap, 'f', named_struct({_features('x.')}))), y -> named_struct('candidate', y.candidate, 'score', transform(array(y.f), f -> {score})[0], 'gap', y.gap))"
    last = f"array(named_struct('candidate', string(null), 'score', double(null), 'gap', element_at({work['gaps']}, -1)))"
    return have.withColumn(out, F.expr(f"concat({scored}, {last})")).drop(*work.values())


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, rejected: bool = False) -> DataFrame:
    """A row for each secret: ``key``, occurrence (from 1, among the candidates), length, secret_sha256 and score.

    ``rejected``: also the candidates that the forest takes for false positives.
    """
    have = scanned(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "hits")
    rows = have.select("key", F.posexplode("hits").alias("at", "hit")).where(F.col("hit.candidate").isNotNull())
    if not rejected:
        rows = rows.where(F.col("hit.score") >= least)
    return rows.select(F.col("key").alias(key), (F.col("at") + 1).alias("occurrence"), F.length("hit.candidate").alias("length"), F.sha2("hit.candidate", 256).alias("secret_sha256"), F.col("hit.score").alias("score"))


def hide_secrets(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``HIDDEN``; null texts stay null."""
    names = docs.columns
    hits = free_name("__hits", names)
    have = scanned(docs, text, hits)
    shown = f"array_join(transform({hits}, x -> concat(x.gap, CASE WHEN x.candidate IS NULL THEN '' WHEN x.score >= {least} THEN '{HIDDEN}' ELSE x.candidate END)), '')"
    return have.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), F.expr(shown))).select(*(f"`{c}`" for c in names))
