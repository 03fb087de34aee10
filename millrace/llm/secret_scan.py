"""Secret scan: candidates judged by a random forest (operator 4, native).

Words of ``LEAST`` characters or more that hold a digit are candidates (of ``name=value``
the value is), and so is every run of such length and with a digit that quotes, brackets
and ``= : , ; & ? @`` set off inside a word. What a key name is assigned to is a candidate
whatever its length and characters. Features of a candidate: its length, its character
transitions and make-up, how much of its letters dictionary words cover, the path it comes
from (the source and whether it looks like a path or address itself) and the name before it.

The forest is trained from labelled findings (``finding``, ``before``, ``path``, ``secret``)
and compiled into one column expression, so scanning is a projection: no shuffle, no
Python, rows and copies alike stay where they are. At most ``FINDINGS`` distinct secrets
and as many distinct harmless findings, those of least hash, are used for training. Where
one of the two is wanting there is no forest, and the labelling rule alone says what is a
secret.

The given tables hold no labelled findings, so ``weak_findings`` labels the corpus' own
candidates by format: assigned to a key name or of an issuer's prefix is a secret;
addresses, plain numbers and words are not.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import table, union

LEAST = 12
FINDINGS = 20_000
MASK = "[secret]"
#: Words whose share of a candidate's letters is its dictionary coverage.
DICTIONARY = "the|and|tion|ing|with|for|que|les|der|und|ich|ein|mail|example|test|com|org|net|http|www|index|version|page|file|data|user|name|date|time|item|order|number"
_KEY = "(token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|(s3|aws|secret|private|signing|encryption|account|storage|master)[_-]?key|auth|credential|bearer)s?[_-]?[0-9]*"
KEY_NAMES = f"(?i)^(.*[_.-])?{_KEY}[:=]?$"

#: What sets runs of a word apart.
_SETS_OFF = r"[\"'`()\[\]<>{}=:,;&?@]"
_RUN = _SETS_OFF.replace("[", "[^", 1)
#: A word that may hold the end of a key name.
_KEY_IN = rf"(?i){_KEY}({_SETS_OFF}|$)"

_FEATURES = ["length", "transitions", "digits", "uppers", "hexes", "others", "variety", "coverage", "key_before", "assigned", "address", "number", "path"]


def _share(value: Column, keep: str) -> Column:
    """The share of characters that match the class ``keep``."""
    return (F.length(value) - F.length(F.regexp_replace(value, keep, ""))) / F.greatest(F.length(value), F.lit(1))


def _features(finding: Column, before: Column, path: Column) -> dict[str, Column]:
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(finding, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")
    lower = F.lower(finding)
    return {
        "length": F.length(finding).cast("double"),
        "transitions": F.length(kinds) / F.greatest(F.length(finding), F.lit(1)),
        "digits": _share(finding, "[0-9]"),
        "uppers": _share(finding, "[A-Z]"),
        "hexes": _share(finding, "[0-9a-f]"),
        "others": _share(finding, "[^0-9A-Za-z]").cast("double"),
        "variety": F.size(F.array_distinct(F.split(finding, ""))) / F.greatest(F.length(finding), F.lit(1)),
        "coverage": _share(lower, DICTIONARY),
        "key_before": F.coalesce(before.rlike(KEY_NAMES), F.lit(False)).cast("double"),
        "assigned": F.coalesce(before.rlike("[:=]$"), F.lit(False)).cast("double"),
        "address": finding.rlike(r"@|://|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|/[^/]+\.[a-z]{2,4}$").cast("double"),
        "number": finding.rlike(r"^[0-9.,:+()/-]+$").cast("double"),
        "path": F.pmod(F.xxhash64(F.coalesce(path, F.lit(""))), F.lit(16)).cast("double"),
    }


def _sign(text: Column) -> Column:
    return F.when(text.contains("="), "=").when(text.contains(":"), ":").otherwise("")


def _name(word: Column) -> Column:
    """The last run of a word, with the sign of assignment after it."""
    return F.concat(F.regexp_extract(word, f"({_RUN}*){_SETS_OFF}*$", 1), _sign(F.regexp_extract(word, f"({_SETS_OFF}*)$", 1)))


def _keyed(before: Column) -> Column:
    """Whether ``before`` is a key name that is assigned to."""
    return before.rlike("[:=]$") & before.rlike(KEY_NAMES)


def candidates(text: Column) -> Column:
    """Array of (finding, before): candidates of a text and the names they follow."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")

    def found(all_words: Column, keys: Column) -> Column:
        def worth(i: Column) -> Column:
            word = F.element_at(all_words, i)
            long = (F.length(word) >= LEAST) & word.rlike("[0-9]")
            return long | F.element_at(keys, i) | ((i > 1) & F.element_at(keys, F.greatest(i - 1, F.lit(1)))) | ((i > 2) & F.element_at(keys, F.greatest(i - 2, F.lit(1))))

        def of_word(i: Column) -> Column:
            word = F.element_at(all_words, i)
            last = F.when(i > 1, F.element_at(all_words, F.greatest(i - 1, F.lit(1)))).otherwise("")
            last2 = F.when(i > 2, F.element_at(all_words, F.greatest(i - 2, F.lit(1)))).otherwise("")
            lead = _sign(F.regexp_extract(word, f"^({_SETS_OFF}*)", 1))
            before = F.when(last.rlike(f"^{_SETS_OFF}+$"), F.concat(F.regexp_replace(_name(last2), "[:=]$", ""), _sign(last))).otherwise(_name(last))
            before = F.when((lead != "") & ~before.rlike("[:=]$"), F.concat(before, lead)).otherwise(before)
            runs = F.regexp_extract_all(word, F.lit(f"{_RUN}+{_SETS_OFF}*"), 0)
            return F.flatten(F.transform(F.array(F.struct(word.alias("word"), before.alias("before"), runs.alias("runs"))), in_word))

        def in_word(w: Column) -> Column:
            value = F.regexp_extract(w["word"], r"^(?:[A-Za-z_.-]{2,40}[=:])?[\"'(\[<{]*([^\"'()\[\]<>{}]*?)[,;.!?#]*(?:[\"'()\[\]<>{}].*)?$", 1)
            own = F.regexp_extract(w["word"], r"^([A-Za-z_.-]{2,40}[=:])", 1)
            whole = F.struct(value.alias("finding"), F.when(own != "", own).otherwise(w["before"]).alias("before"))

            def run(r: Column, k: Column) -> Column:
                before = F.when(k > 0, _name(F.element_at(w["runs"], F.greatest(k, F.lit(1))))).otherwise(w["before"])
                return F.struct(F.regexp_extract(r, f"^({_RUN}*?)[.!#]*(?:{_SETS_OFF}.*)?$", 1).alias("finding"), before.alias("before"))

            pieces = F.filter(F.transform(w["runs"], run), lambda c: c["finding"] != value)
            judged = lambda c: c["finding"].rlike(_RUN) & (((F.length(c["finding"]) >= LEAST) & c["finding"].rlike("[0-9]")) | _keyed(c["before"]))
            return F.filter(F.concat(F.array(whole), pieces), judged)

        return F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.size(all_words)), worth), of_word))

    # the words, and which of them may hold a key name, are bound once, as the only element of an array
    with_keys = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.transform(w, lambda x: x.rlike(_KEY_IN)).alias("keys")))
    return F.flatten(F.transform(with_keys, lambda b: found(b["words"], b["keys"])))


def _secret_format(finding: Column, before: Column) -> Column:
    """Whether the format of a finding and of the name before it says it is a secret."""
    issued = finding.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abp]-")
    long = before.rlike(KEY_NAMES) & finding.rlike("^(?=.*[0-9])[0-9A-Za-z+/_-]{16,}=*$")
    short = _keyed(before) & finding.rlike("^(?=.*[0-9])(?=.*[A-Za-z])[^@:/]{6,}$")
    return F.coalesce(issued | long | short, F.lit(False))


def weak_findings(docs: DataFrame) -> DataFrame:
    """Findings of ``docs`` (text, source) that their format labels."""
    found = docs.select(F.explode(candidates(F.col("text"))).alias("c"), F.col("source").alias("path")).select("c.finding", "c.before", "path")
    secret = _secret_format(F.col("finding"), F.col("before"))
    address = F.col("finding").rlike(r"@|://|^[0-9.,:+()/-]+$")
    plain = F.col("finding").rlike(r"^[^0-9]+[0-9]{1,2}$") | (F.size(F.split("finding", "[0-9]+")) <= 2)
    # few digits make no key harmless; words that stand for no key do
    stands = F.col("finding").rlike("(?i)^(true|false|null|none|nil|yes|no|on|off|string|str|text|int|required|optional|basic|bearer|undefined|.{1,3})$")
    harmless = address | F.when(_keyed(F.col("before")), stands).otherwise(plain)
    return found.withColumn("secret", F.when(secret, 1.0).when(harmless, 0.0)).where("secret IS NOT NULL")


def _compiled(model: RandomForestClassificationModel) -> list[str]:
    """Each tree as an SQL expression over the struct ``f`` of features, 1 for a secret."""
    trees: list[list[str]] = []

    def node(lines: list[str]) -> str:
        line = lines.pop(0).strip()
        if m := re.match(r"Predict: (\S+)", line):
            return "1" if float(m[1]) > 0.5 else "0"
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node(lines)
        lines.pop(0)
        return f"CASE WHEN f.{_FEATURES[int(m[1])]} <= {float(m[2])!r}D THEN {yes} ELSE {node(lines)} END"

    for line in model.toDebugString.splitlines()[1:]:
        if line.strip().startswith("Tree"):
            trees.append([])
        else:
            trees[-1].append(line)
    return [node(t) for t in trees]


def train(findings: DataFrame, trees: int = 15, depth: int = 6, seed: int = 7) -> list[str] | None:
    """The forest's trees, from labelled findings; None without findings of both kinds."""
    chosen = findings.where("finding IS NOT NULL").select("finding", "before", "path", F.col("secret").cast("double").alias("label"))
    order = [F.xxhash64("finding", "before", "path"), "finding", "before", "path"]
    # by label, as secrets are rare; copies of one finding count once
    chosen = union([chosen.where(F.col("label") == label).distinct().orderBy(*order).limit(FINDINGS) for label in (0.0, 1.0)])
    columns = _features(F.col("finding"), F.col("before"), F.col("path"))
    rows = chosen.select("label", *(c.alias(k) for k, c in columns.items())).coalesce(1)
    data = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(rows).select("label", "features").cache()
    try:
        if data.select("label").distinct().count() < 2:
            return None
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
        return _compiled(forest.fit(data))
    finally:
        data.unpersist()


def secrets(text: Column, path: Column, trees: list[str] | None) -> Column:
    """Array of (finding, before, votes, secret) of a text.

    NULL and empty texts have none. Without a forest the labelling rule has the only vote.
    """

    def judge(c: Column) -> Column:
        if not trees:
            rule = _secret_format(c["finding"], c["before"])
            return F.struct(c["finding"].alias("finding"), c["before"].alias("before"), rule.cast("int").alias("votes"), rule.alias("secret"))
        f = F.struct(*(v.alias(k) for k, v in _features(c["finding"], c["before"], path).items()))
        votes = F.transform(F.array(f), lambda f: sum((_tree(t, f) for t in trees), F.lit(0)))[0]
        return F.struct(c["finding"].alias("finding"), c["before"].alias("before"), votes.alias("votes"), (votes * 2 > len(trees)).alias("secret"))

    return F.transform(candidates(text), judge)


def _tree(tree: str, features: Column) -> Column:
    """One tree as a column of the features that a lambda was given."""
    at = 0
    tokens = re.findall(r"CASE WHEN f\.(\w+) <= (\S+)D THEN|(ELSE)|(END)|([01])(?= |$)", tree)

    def node() -> Column:
        nonlocal at
        name, cut, _, _, leaf = tokens[at]
        at += 1
        if leaf:
            return F.lit(int(leaf))
        yes = node()
        at += 1  # ELSE
        no = node()
        at += 1  # END
        return F.when(features[name] <= float(cut), yes).otherwise(no)

    return node()


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """``docs`` with a column ``_found`` (see ``secrets``); all else stays as it is."""
    trees = train(weak_findings(docs) if findings is None else findings)
    return docs.withColumn("_found", secrets(F.col(text), F.col(path), trees))


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every secret replaced by ``MASK``; the longest first, as one may hold another.

    One of ``LEAST`` characters or more is replaced wherever it stands, a shorter one only
    after its name, as it may be a common word elsewhere.
    """

    def of(c: Column) -> Column:
        short = F.length(c["finding"]) < LEAST
        return F.struct(-F.length(c["finding"]), c["finding"].alias("finding"), F.when(short, F.regexp_replace(c["before"], "[:=]$", "")).alias("name"))

    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    def mask(acc: Column, s: Column) -> Column:
        between = rf"(?:{_SETS_OFF}|[\x20\x09-\x0D])"
        after = F.concat(F.lit("("), quoted(s["name"]), F.lit(f"{between}*[=:]{between}*)"), quoted(s["finding"]), F.lit(rf"(?=[.!#]*(?:{between}|$))"))
        return F.when(s["name"].isNull(), F.replace(acc, s["finding"], F.lit(MASK))).otherwise(F.regexp_replace(acc, after, F.lit(f"$1{MASK}")))

    longest = F.sort_array(F.array_distinct(F.transform(F.filter(found, lambda c: c["secret"]), of)))
    return F.aggregate(longest, text, mask)


def op4(spark, sf_dir) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    secret = F.filter("_found", lambda c: c["secret"])
    return found.select(
        F.col("doc_id").cast("long"),
        F.size("_found").cast("long").alias("n_candidates"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.transform(secret, lambda c: F.sha2(c["finding"], 256)).alias("secret_sha256"),
        F.sha2(F.coalesce(redacted(F.col("text"), F.col("_found")), F.lit("")), 256).alias("redacted_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with its secrets masked and n_chars as the text is then."""
    text = redacted(F.col("text"), F.col("_found"))
    out = scan(docs).withColumn("text", text).drop("_found")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
