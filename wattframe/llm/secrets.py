"""Secret scan: candidates by shape, false positives removed by a random forest.

Candidates are long runs of key characters with digits or odd capitals, wherever they stand in a word, and
whatever a secret's name is given, however short or plain it is. Each has features of
its length and characters, of the transitions between its characters as they occur
in the corpus' own words, of how much of it dictionary words cover, of paths and
addresses, of its document's path, and of the words beside it. The forest is fitted
on labelled findings: by default candidates in the fixed formats of providers, or
given as the value of a secret's name, against candidates of known harmless forms.
It then decides on every candidate, known formats included.

All of it is DataFrame code. The dictionary and the transitions count the words of
all texts; the transitions are a table of at most 36 x 36 rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.scratch import Scratch, columns_of, whole_text

MIN_LENGTH = 12
#: Words of letters only that occur this often make the dictionary.
DICTIONARY_COUNT = 20
#: Findings of each label the forest is fitted on, about.
TRAIN_FINDINGS = 20_000
TREES, LEAF_DEPTH, SEED = 24, 6, 7
DECISION = 0.5
MASK = "[SECRET]"

# Formats of providers' keys, and words that go with secrets or with harmless numbers.
PROVIDER_FORMATS = (
    r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    r"^gh[pousr]_[0-9A-Za-z]{36}$",
    r"^github_pat_[0-9A-Za-z_]{60,}$",
    r"^xox[abprs]-[0-9A-Za-z-]{10,}$",
    r"^[sr]k_(live|test)_[0-9A-Za-z]{16,}$",
    r"^AIza[0-9A-Za-z_-]{35}$",
    r"^glpat-[0-9A-Za-z_-]{20}$",
    r"^eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]*$",
)
SECRET_WORDS = r"(?i)(passw|pwd|secret|token|api|auth|credential|bearer|private|access.?key|client.?key)"
HARMLESS_WORDS = (
    r"(?i)(commit|sha|md5|hash|checksum|digest|revision|uuid|guid|version|isbn|doi|example|sample|dummy|placeholder|order|invoice|phone|mail)"
)
EXAMPLE_PATHS = r"(?i)(test|example|sample|spec|mock|fixture|demo|doc)"
HARMLESS_FORMATS = (
    r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    r"^([a-z]+:)?//.*$",
    r"^(www\.|/|\./|\.\./).*$",
    r"^[0-9]{1,4}([-/.:][0-9]{1,4}){1,7}$",
    r"^[+]?[0-9][0-9.-]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[vV]?[0-9]+([.][0-9A-Za-z]+)+$",
    r"^[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.](com|org|net|io|edu|gov)$",
)

_SAME = ("h1", "h2")  # 128 bits of the text stand for it
# A digit, many capitals, or capitals inside a word: what plain words do not have.
_MIXED = r"[0-9]|[A-Z]{8}|[a-z][A-Z]"
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]{0,40}"
_GIVEN = r"\\?[\"']?(?::=|=|:(?!//))\\?[\"']?"
#: A run of key characters, and the name it is given to.
_RUN = rf"(?:({_NAME}){_GIVEN})?((?:[A-Za-z]{{2,12}}://)?[A-Za-z0-9+/_.~@-]{{{MIN_LENGTH},}}(?:={{1,2}}(?![A-Za-z0-9=]))?)"
#: Where the next name=value of a word begins.
_NEXT = rf"[?&,;{{}}<>](?=\\?[\"']?{_NAME}{_GIVEN})"
_SECRET_NAME = rf"(?=[A-Za-z0-9_.-]{{0,40}}{SECRET_WORDS}){_NAME}"
# Up to the quote where it is quoted, else up to a sign that ends values in tables, code and markup.
_ANY_VALUE = r"((?<=\")[^\"]+|(?<=')[^']+|(?<![\"'])[^\"',;<>]+)"
#: A secret's name with what it is given: groups are the head, the name, a word within it, the value.
_NAMED = rf"(({_SECRET_NAME}){_GIVEN}){_ANY_VALUE}"
_HEAD_GROUP, _NAME_GROUP, _VALUE_GROUP = 1, 2, 4
#: The end of the words before a value that is given to a secret's name.
_NAMED_BEFORE = rf"(?:^|[^A-Za-z0-9_.-]){_SECRET_NAME}[\"']? ?(?::=|=|:)$"
_TURN = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"

FEATURES = [
    "length", "digits", "upper", "lower", "signs", "turns", "entropy", "hex_only",
    "transition", "coverage", "slashes", "dots", "at_sign", "example_path",
    "assigned", "secret_word", "harmless_word", "known_format", "harmless_format",
]


def _any(value: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [value.rlike(p) for p in patterns])


def _share(value: Column, characters: str) -> Column:
    return F.regexp_count(value, F.lit(f"[{characters}]")) / F.length(value)


def _literal(value: Column) -> Column:
    """A pattern for just this text."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _found(value: Column, name: Column, lead: Column) -> Column:
    return F.struct(value.alias("value"), name.alias("name"), lead.alias("lead"))


def _runs(piece: Column) -> Column:
    """Long runs of key characters, each with its name or an empty one."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(piece, F.lit(_RUN), F.lit(1)).alias("name"),
        F.regexp_extract_all(piece, F.lit(_RUN), F.lit(2)).alias("value"),
    )
    trimmed = F.transform(
        pairs,
        lambda p: _found(
            F.regexp_replace(F.regexp_replace(p["value"], r"^[^A-Za-z0-9+/]+", ""), r"[^A-Za-z0-9+/=]+$", ""),
            p["name"], F.lit(None).cast("string"),
        ),
    )
    return F.filter(trimmed, lambda p: (F.length(p["value"]) >= MIN_LENGTH) & p["value"].rlike(_MIXED))


def _given(piece: Column) -> Column:
    """What a secret's name is given in this piece, if it is."""
    value = F.regexp_replace(F.regexp_extract(piece, _NAMED, _VALUE_GROUP), r"[)\]}.:\\]+$", "")
    one = _found(value, F.regexp_extract(piece, _NAMED, _NAME_GROUP), _literal(F.regexp_extract(piece, _NAMED, _HEAD_GROUP)))
    return F.when(piece.rlike(_NAMED) & (value != ""), F.array(one)).otherwise(F.array().cast(_FOUND))


_FOUND = "array<struct<value:string,name:string,lead:string>>"


def candidates(texts: DataFrame) -> DataFrame:
    """``(h1, h2, path, place, value, name, before, lead)`` of each text's candidates.

    ``place`` counts words, ``name`` is what the value is assigned to in the same
    word, ``before`` are the two words before it. ``lead`` is a pattern of what stands
    before the value where a secret's name is given it, and null otherwise.
    """
    words = texts.select(*_SAME, "path", F.split(F.translate("text", "\n\t\r\f\x0b", "     "), " ").alias("words"))

    def before(i: Column) -> Column:
        return F.concat_ws(" ", F.when(i > 1, F.get("words", i - 2)), F.when(i > 0, F.get("words", i - 1)))

    def told(i: Column) -> Column:
        """Whether the words before it give it to a secret's name."""
        return F.when(i > 0, F.get("words", i - 1).rlike("[=:]$") & before(i).rlike(_NAMED_BEFORE)).otherwise(False)

    def looked_at(i: Column) -> Column:
        word = F.get("words", i)
        return ((F.length(word) >= MIN_LENGTH) & word.rlike(_MIXED)) | (word.rlike("[=:].") & word.rlike(_NAMED)) | ((word != "") & told(i))

    found = words.select(
        *_SAME, "path", "words", F.explode(F.filter(F.sequence(F.lit(0), F.size("words") - 1), looked_at)).alias("place")
    ).select(
        *_SAME,
        "path",
        "place",
        F.get("words", F.col("place")).alias("word"),
        before(F.col("place")).alias("before"),
        told(F.col("place")).alias("told"),
    )
    pieces = F.split("word", _NEXT)
    within = F.flatten(F.transform(pieces, lambda p: F.concat(_given(p), _runs(F.regexp_replace(p, _NAMED, " ")))))
    # the word as a whole, out of its quotes or up to a sign that ends it
    opened = r"^[\"'({\[]*"
    whole = F.regexp_replace(F.regexp_extract("word", opened + _ANY_VALUE, 1), r"[)\]}.:\\]+$", "")
    lead = F.concat(F.replace(_literal(F.col("before")), F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\s+[\"'({\[]*"))
    alone = F.when(whole != "", F.array(_found(whole, F.lit(""), lead))).otherwise(F.array().cast(_FOUND))
    return (
        found.withColumn("found", F.explode(F.when(F.col("told") & ~F.col("word").rlike(_NAMED), alone).otherwise(within)))
        .select(*_SAME, "path", "place", "before", "found.*")
        .distinct()
    )


def dictionary(texts: DataFrame, least: int = DICTIONARY_COUNT) -> DataFrame:
    """``(word, n)``: lower-case words of letters only, with how often they occur."""
    return (
        texts.select(F.explode(F.split(F.translate(F.lower("text"), "\n\t\r\f\x0b.,;:!?\"()", "     "), " ")).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= least) & F.col("word").rlike(r"^\p{L}{2,30}$"))
    )


def _transitions(words: DataFrame) -> Column:
    """Map from two characters to the logarithm of how likely the second follows the first."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = (
        words.where(F.col("word").rlike("^[a-z0-9]{2,}$"))
        .select("n", F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most 36 x 36 rows
    )
    first: dict[str, int] = {}
    for row in pairs:
        first[row["pair"][0]] = first.get(row["pair"][0], 0) + row["n"]
    logs = {r["pair"]: F.log(F.lit((r["n"] + 0.5) / (first[r["pair"][0]] + 18.0))) for r in pairs}
    if not logs:
        return F.lit(None).cast("map<string,double>")
    return F.create_map(*[x for pair, value in sorted(logs.items()) for x in (F.lit(pair), value)])


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``."""
    value, lower = F.col("value"), F.lower("value")
    runs = (
        found.select("value", F.explode(F.regexp_extract_all(lower, F.lit(r"([a-z]{3,})"))).alias("word"))
        .distinct()
        .join(words.select("word"), "word", "left_semi")
        .groupBy("value")
        .agg(F.collect_set("word").alias("known"))
    )
    marked = found.join(runs, "value", "left").withColumn(
        "known", F.coalesce("known", F.array().cast("array<string>"))
    )
    counts = F.transform(F.array_distinct(F.split(value, "")), lambda c: F.length(value) - F.length(F.replace(value, c, F.lit(""))))
    entropy = F.aggregate(
        counts, F.lit(0.0), lambda total, n: total - F.when(n > 0, n / F.length(value) * F.log2(n / F.length(value))).otherwise(0.0)
    )
    table = _transitions(words)
    steps = F.transform(
        F.sequence(F.lit(1), F.length(value) - 1),
        lambda i: F.coalesce(F.try_element_at(F.col("logs"), F.substring(lower, i, F.lit(2))), F.lit(-6.0)),
    )
    covered = F.aggregate(
        F.filter(F.regexp_extract_all(lower, F.lit(r"([a-z]{3,})")), lambda w: F.array_contains("known", w)),
        F.lit(0), lambda total, w: total + F.length(w),
    )
    beside = F.concat_ws(" ", "name", "before")
    flags = {
        "hex_only": value.rlike("^[0-9a-fA-F]+$"),
        "example_path": F.coalesce(F.col("path").rlike(EXAMPLE_PATHS), F.lit(False)),
        "assigned": (F.col("name") != "") | F.col("before").rlike(r"[=:]\S?\s*$"),
        "secret_word": beside.rlike(SECRET_WORDS),
        "harmless_word": beside.rlike(HARMLESS_WORDS),
        "known_format": _any(value, PROVIDER_FORMATS),
        "harmless_format": _any(value, HARMLESS_FORMATS),
    }
    return marked.withColumn("logs", table).withColumns(
        {
            "length": F.length(value).cast("double"),
            "digits": _share(value, "0-9"),
            "upper": _share(value, "A-Z"),
            "lower": _share(value, "a-z"),
            "signs": _share(value, "^A-Za-z0-9"),
            "turns": F.regexp_count(value, F.lit(_TURN)) / F.length(value),
            "entropy": entropy,
            "transition": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.length(value) - 1, F.lit(1)),
            "coverage": covered / F.length(value),
            "slashes": F.regexp_count(value, F.lit("/")).cast("double"),
            "dots": F.regexp_count(value, F.lit("[.]")).cast("double"),
            "at_sign": F.regexp_count(value, F.lit("@")).cast("double"),
            **{k: v.cast("double") for k, v in flags.items()},
        }
    ).drop("logs", "known")


def rule_label() -> Column:
    """1 for findings sure to be secrets, 0 for sure harmless ones, null for the others."""
    given = (F.col("assigned") == 1) & (F.col("secret_word") == 1) & (F.col("harmless_word") == 0)
    random = (F.col("entropy") >= 2.8) & (F.col("coverage") < 0.4) & (F.col("harmless_format") == 0)
    return (
        F.when((F.col("known_format") == 1) | (given & random), 1.0)
        .when((F.col("harmless_format") == 1) | ((F.col("harmless_word") == 1) & (F.col("secret_word") == 0)), 0.0)
        .when((F.col("coverage") >= 0.6) & (F.col("secret_word") == 0), 0.0)
    )


def scored(features: DataFrame, train_findings: int = TRAIN_FINDINGS) -> DataFrame:
    """Adds ``score``, the forest's share of votes for a secret.

    ``label`` is 1, 0 or null. Equal findings count once; about ``train_findings`` of
    each label are learned from. Where only one label occurs there is nothing to
    learn, and the score is that label for labelled findings and 0 for the others.
    """
    known = features.where(F.col("label").isNotNull()).select("value", "label", *FEATURES).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return features.withColumn("score", F.coalesce("label", F.lit(0.0)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, train_findings / n))])
    sample = known.where(F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < share[F.col("label")] * (1 << 20))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", probabilityCol="votes", numTrees=TREES, maxDepth=LEAF_DEPTH, seed=SEED
    ).fit(assembler.transform(sample.orderBy("value", *FEATURES)))
    out = forest.transform(assembler.transform(features))
    return out.withColumn("score", vector_to_array("votes")[1]).drop("vector", "votes", "rawPrediction", "prediction")


def _keyed(docs: DataFrame, text_column: str, path_column: str | None) -> DataFrame:
    """``(doc, text, path, h1, h2)``: the whole row as a struct, and what is looked at."""
    path = F.coalesce(F.col(f"`{path_column}`").cast("string"), F.lit("")) if path_column else F.lit("")
    texts = docs.select(F.struct("*").alias("doc"), whole_text(f"`{text_column}`").alias("text"), path.alias("path"))
    return texts.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def find_secrets(
    docs: DataFrame,
    text_column: str = "text",
    path_column: str | None = "source",
    labelled: DataFrame | None = None,
) -> DataFrame:
    """``(h1, h2, path, place, value, lead, score, is_secret)`` of every candidate of every different text.

    ``labelled`` may give findings by ``value`` with a ``label``; by default
    ``rule_label`` labels those it is sure of. Equal texts of one path are searched
    once; ``h1`` and ``h2`` are 128 bits of the text, through which documents find
    their findings. A null path is an empty one.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    texts = _keyed(docs, text_column, path_column).select(*_SAME, "path", "text")
    found = scratch.keep(candidates(texts))
    words = scratch.keep(dictionary(texts))
    features = with_features(found, words)
    if labelled is None:
        features = features.withColumn("label", rule_label())
    else:
        given = labelled.groupBy("value").agg(F.max("label").cast("double").alias("label"))
        features = features.join(given, "value", "left")
    features = scratch.keep(features)
    out = scored(features).withColumn("is_secret", F.col("score") >= DECISION)
    kept = scratch.keep(out.select(*_SAME, "path", "place", "value", "lead", "score", "is_secret"))
    scratch.drop(found, words, features)
    return kept


def mask_secrets(
    docs: DataFrame,
    text_column: str = "text",
    path_column: str | None = "source",
    labelled: DataFrame | None = None,
) -> DataFrame:
    """``(doc, text, n_candidates, n_secrets)``: each row as a struct, and its text without secrets.

    Every place in the text where one of its secrets stands is replaced by
    ``[SECRET]``, longer ones first; one that could be a plain word or is short only
    where a secret's name is given it. All rows stay; a null or empty text becomes an
    empty one. Repeated rows and rows without an id or path are searched like any
    other. An empty table gives an empty one.
    """
    found = find_secrets(docs, text_column, path_column, labelled)
    plain = (F.length("value") < MIN_LENGTH) | ~F.col("value").rlike(_MIXED)
    placed = F.when(plain, F.concat(F.lit("("), F.col("lead"), F.lit(")"), _literal(F.col("value")), F.lit("(?![A-Za-z0-9])")))
    # those of one place come first, as long as what leads to them stands
    secret = F.when(
        F.col("is_secret"),
        F.struct(placed.isNull().alias("anywhere"), (-F.length("value")).alias("size"), "value", placed.alias("placed")),
    )
    # the findings grow with the documents: one plan at every size
    per_text = Scratch(docs.sparkSession, "secrets").keep(
        found.groupBy(*_SAME, "path").agg(
            F.count(F.lit(1)).alias("n_candidates"),
            F.count_if("is_secret").alias("n_secrets"),
            F.collect_set(secret).alias("secrets"),
        )
    )
    masked = F.aggregate(
        F.sort_array("secrets"),
        F.col("text"),
        lambda text, s: F.when(s["anywhere"], F.replace(text, s["value"], F.lit(MASK))).otherwise(
            F.regexp_replace(text, F.coalesce(s["placed"], F.lit("$.")), F.lit(f"$1{MASK}"))
        ),
    )
    return (
        _keyed(docs, text_column, path_column)
        .join(per_text.hint("merge"), [*_SAME, "path"], "left")
        .select(
            "doc",
            F.when(F.col("n_secrets") > 0, masked).otherwise(F.col("text")).alias("text"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_candidates", "n_secrets")],
        )
    )
