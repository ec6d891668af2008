"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is any part of a word that could be a key: eight or more characters
of the alphabets in use, one of them a digit. Behind a secret's name the digit
is not needed, and the value with all its other signs is a candidate as well.
The forest sees its length, its character transitions, how much of it a
dictionary of the corpus covers, path-like parts, and the words next to it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphslice.llm.text import let, words
from graphslice.plans.workspace import Workspace

DICTIONARY_WORDS = 4096  # the most frequent of the corpus
FINDINGS_PER_CLASS = 8192  # labelled findings that a forest is fitted on, at most
TREES, DEPTH, SEED = 24, 6, 11
REDACTED = "[SECRET]"

_SIGNS = r"A-Za-z0-9+/_.@\-"
_RUN = f"([{_SIGNS}]+)([^{_SIGNS}]*)"  # with what stands between it and the next
_ASSIGNED = r"([A-Za-z_][A-Za-z0-9_.\-]*)[\"']?\s*[=:]"
_SECRET_NAME = r"(?i)pass|pwd|secret|token|key|auth|cred"
#: Any signs up to a quote, or to a separator that a further name follows.
_ANY = r"((?:(?![&,;][\"']?[A-Za-z_][A-Za-z0-9_.\-]*[\"']?[=:])[^\"'])+)"
_ANY_ASSIGNED = (
    r"((?i:[A-Za-z0-9_.\-]*(?:pass|pwd|secret|token|key|auth|cred)[A-Za-z0-9_.\-]*))[\"'\\]*(?:=>|:=|[=:])[\"']?" + _ANY
)
#: A name of words, all small or with a capital first, that may end in a few digits.
_PATH_PART = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_.\-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[0-9]{0,4}"
FEATURES = (
    "length", "digits", "uppers", "lowers", "hex", "digit_letter", "lower_upper", "vowel_consonant",
    "covered", "slashes", "dots", "ats", "assigned", "secret_name", "quoted", "known_before", "known_after",
)


def candidates(docs: DataFrame) -> DataFrame:
    """Rows ``key, doc_id, place, name, value, quoted, before, after`` of ``docs`` (``key, doc_id, text``).

    ``place`` is the word's number, ``name`` what is assigned to, in the word
    or before it, and null if there is none.
    """

    def found(tokens: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            earlier = F.when(before.isin("=", ":"), F.lower(F.get(tokens, i - 2)))
            earlier = F.coalesce(earlier, F.lower(F.regexp_extract(before, _ASSIGNED + "$", 1)), F.lit(""))
            could = word.rlike("[0-9]") | word.rlike(_SECRET_NAME) | before.rlike("[=:]$")
            return F.when(
                (F.length(word) >= 8) & could,
                F.transform(
                    let(earlier, lambda name: _parts(word, name)),
                    lambda part: F.struct(
                        i.cast("long").alias("place"),
                        part["name"].alias("name"),
                        part["value"].alias("value"),
                        word.rlike("[\"']").alias("quoted"),
                        F.lower(before).alias("before"),
                        F.lower(F.get(tokens, i + 1)).alias("after"),
                    ),
                ),
            )

        return F.flatten(F.filter(F.transform(tokens, one), lambda c: c.isNotNull()))

    each = docs.select("key", "doc_id", F.explode(let(words(F.col("text")), found)).alias("found"))
    return each.select("key", "doc_id", "found.*")


def _parts(word: Column, earlier: Column) -> Column:
    """The candidates in a word, as structs of ``name`` and ``value``; ``earlier`` is a name before the word, or empty."""
    between = F.regexp_extract_all(word, F.lit(_RUN), F.lit(2))
    part = lambda name, value: F.struct(name.alias("name"), value.alias("value"))

    def of_runs(runs: Column, gaps: Column) -> Column:
        def one(run: Column, k: Column) -> Column:
            assigned = F.get(gaps, k - 1).rlike(r"^[\"'\\\]]*(=>|:=|[=:])")
            own = F.when(assigned, F.lower(F.regexp_extract(F.get(runs, k - 1), r"([A-Za-z_][A-Za-z0-9_.\-]*)$", 1)))
            name = F.when(own != "", own).when(earlier != "", earlier)
            padding = F.when(k == F.size(runs) - 1, F.regexp_extract(F.get(gaps, k), "^={1,2}", 0)).otherwise(
                F.regexp_extract(F.get(gaps, k), r"^(={1,2})(?:[^=\"'>].*|[\"'].+)$", 1)
            )
            core = F.regexp_extract(run, r"^(.*?)[.@]*$", 1)
            return F.when(F.length(core) >= 8, part(name, F.concat(core, padding)))

        return F.transform(runs, one)

    runs = let(
        F.regexp_extract_all(word, F.lit(_RUN), F.lit(1)), lambda r: let(between, lambda gaps: of_runs(r, gaps))
    )
    runs = F.filter(runs, lambda p: p.isNotNull() & (p["value"].rlike("[0-9]") | F.coalesce(p["name"], F.lit("")).rlike(_SECRET_NAME)))
    wholes = F.zip_with(
        F.regexp_extract_all(word, F.lit(_ANY_ASSIGNED), F.lit(1)),
        F.regexp_extract_all(word, F.lit(_ANY_ASSIGNED), F.lit(2)),
        lambda name, value: part(F.lower(name), value),
    )
    alone = F.when(earlier.rlike(_SECRET_NAME), F.array(part(earlier, F.regexp_extract(word, "^[\"']?" + _ANY, 1))))
    wholes = F.concat(wholes, F.coalesce(alone, F.array().cast("array<struct<name:string,value:string>>")))
    trimmed = F.transform(wholes, lambda p: part(p["name"], F.regexp_replace(p["value"], r"[.,;:)\]}\\]+$", "")))
    signed = lambda p: (F.length(p["value"]) >= 8) & p["value"].rlike(f"[^{_SIGNS}=]")
    return F.array_distinct(F.concat(runs, F.filter(trimmed, signed)))


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> DataFrame:
    """One row, ``words``: the most frequent words of three or more letters in the whole corpus; ties by word."""
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    counts = docs.select(tokens.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    most = counts.orderBy(F.desc("n"), "word").limit(size)
    return Workspace(docs.sparkSession, "lexicon").save(most.agg(F.collect_list("word").alias("words")), "words")


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with the columns of :data:`FEATURES`, all double; ``known`` is a :func:`dictionary`."""
    value, size = F.col("value"), F.length("value")
    in_lexicon = lambda word: F.coalesce(F.array_contains(known.scalar(), F.regexp_replace(word, r"[^\p{L}]+$", "")), F.lit(False))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    runs = F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0))
    in_words = lambda lexicon: F.aggregate(
        runs, F.lit(0), lambda n, run: n + F.when(F.array_contains(lexicon, run), F.length(run)).otherwise(0)
    )
    # A subquery cannot stand inside a lambda function; as the column is named once, no row carries it.
    covered = let(F.col("_lexicon"), in_words)
    made = {
        "length": size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "hex": share("[0-9a-f]"),
        "digit_letter": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "lower_upper": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_consonant": share("(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
        "covered": covered / size,
        "slashes": share("/"),
        "dots": share(r"\."),
        "ats": share("@"),
        "assigned": F.col("name").isNotNull(),
        "secret_name": F.coalesce(F.col("name").rlike(_SECRET_NAME), F.lit(False)),
        "quoted": F.col("quoted"),
        "known_before": in_lexicon(F.col("before")),
        "known_after": in_lexicon(F.col("after")),
    }
    columns = [made[name].cast("double").alias(f"f_{name}") for name in FEATURES]
    return found.withColumn("_lexicon", known.scalar()).select(*found.columns, *columns)


def labelled(found: DataFrame) -> DataFrame:
    """Findings whose shape alone decides, with ``label``: 1 for keys of a known make and random values
    assigned to a name of secrets; 0 for numbers, addresses, names of hosts, files and folders, and dictionary
    words. What only looks a little like those, as a key with slashes or dots does, has no label."""
    value, name = F.col("value"), F.coalesce("name", F.lit(""))
    made = (
        value.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$")
        | value.rlike("^(gh[pousr]_|sk_live_|xox[abpr]-)[A-Za-z0-9\\-]{10,}$")
        | value.rlike(r"^eyJ[A-Za-z0-9_\-]{5,}\.eyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{10,}$")
    )
    random = name.rlike(_SECRET_NAME) & value.rlike("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_\\-]{16,}=*$")
    plain = (
        value.rlike(r"^[0-9+.\-]+$")
        | value.rlike(r"^[^@]+@[^@]+\.[A-Za-z]+$")
        | value.rlike(r"^[A-Za-z0-9\-]{1,40}(\.[A-Za-z0-9\-]{1,40})*\.[A-Za-z]{2,12}$")
        | value.rlike(r"^[A-Za-z]{4,}[0-9]{1,4}$")
        | value.rlike(f"^/?({_PATH_PART}/)+({_PATH_PART})?$")
    )
    label = F.when(made | random, 1.0).when(plain & ~name.rlike(_SECRET_NAME), 0.0)
    return found.withColumn("label", label).where("label IS NOT NULL")


def fit(findings: DataFrame) -> RandomForestClassificationModel | float:
    """A forest fitted on :func:`featured` ``findings`` with ``label`` 0 or 1.

    Of each class the findings with the least hash of id, place and value are
    taken, ``FINDINGS_PER_CLASS`` at most. Where there is only one class the
    model is its label, and 0 where there is none.
    """
    folder = Workspace(findings.sparkSession, "forest")
    mark = F.xxhash64("doc_id", "place", "value")
    names = [f"f_{name}" for name in FEATURES]
    ranked = findings.select(*names, "label", mark.alias("mark"))
    parts = [
        ranked.where(F.col("label") == label).orderBy("mark", *names).limit(FINDINGS_PER_CLASS) for label in (0.0, 1.0)
    ]
    sample = folder.save(parts[0].unionByName(parts[1]), "sample")
    classes = [row["label"] for row in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        return classes[0] if classes else 0.0
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2
    )
    # The stored model leaves the fit's summary behind, which holds the session and cannot be sent to tasks.
    forest.fit(_vectors(sample.orderBy("mark", *names))).save(folder.path("model"))
    return RandomForestClassificationModel.load(folder.path("model"))


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{name}" for name in FEATURES], outputCol="features").transform(found)


def judge(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """:func:`featured` candidates with ``score`` and ``secret`` (score of 0.5 or more)."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_vectors(found))
        scored = scored.withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.select("key", "doc_id", "place", "name", "value", "score", (F.col("score") >= 0.5).alias("secret"))


def scan(docs: DataFrame) -> DataFrame:
    """All candidates of ``docs`` (``doc_id, text``) with the forest's verdict.

    Returns ``key, doc_id, place, name, value, score, secret``; ``key`` marks
    the row by id and text. Null and empty texts have no candidates, repeated
    rows have theirs again, and further columns are ignored. An empty table
    has no findings.
    """
    folder = Workspace(docs.sparkSession, "secrets")
    rows = docs.select(row_key(), "doc_id", "text")
    found = folder.save(featured(candidates(rows), dictionary(docs)), "findings")
    return judge(found, fit(labelled(found)))


def row_key() -> Column:
    return F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text")).alias("key")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced, wherever it stands in its text; ``n_chars`` follows if there is one."""
    hits = scan(docs).where("secret").groupBy("key").agg(F.collect_set("value").alias("_values"))
    longest = F.transform(
        F.array_sort(F.transform("_values", lambda v: F.struct(-F.length(v), v.alias("v")))), lambda x: x.getField("v")
    )
    clean = F.aggregate(longest, F.col("row.text"), lambda text, v: F.replace(text, v, F.lit(REDACTED)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key()).join(hits, "key", "left")
    text = F.when(F.col("_values").isNull(), F.col("row.text")).otherwise(clean)
    columns = {name: F.col(f"row.`{name}`") for name in docs.columns} | {"text": text}
    if "n_chars" in columns:
        changed = F.length(text).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("_values").isNull(), columns["n_chars"]).otherwise(changed)
    return rows.select(*(column.alias(name) for name, column in columns.items()))
