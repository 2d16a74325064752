"""Problem 6: defective prompt and response pairs.

Refusals are told by templates. Openings of responses (their first ``OPENING``
words outside quotes, and those of the first later sentence that speaks in the
first person) are clustered by MinHash of their words, each candidate verified
by exact Jaccard similarity. A cluster that recurs over unrelated prompts
(prompts of different clusters) is a template. That a template recurs does not
tell a refusal from a stock phrase, so the templates most of whose openings
speak in the first person and deny something are the seeds, and word weights
(log odds of a word in seed openings against those not in the first person,
counted over all openings) are learned from them. The members of a seed are refusals, and so is every other
opening in the first person whose words weigh enough. Copies, languages and broken ends are told
by one check each:

* copy: the response without labels and quotes is the question, once or twice,
  nearly unchanged;
* language: a trigram classifier trained on labelled documents names another
  language for the response than for its question; a question too short to
  name has the language that most of its answers share;
* termination: a response without a closing stop ends in a word that, over all
  responses, hardly ever ends a sentence, or in a piece of a word.

Statistics (clusters, word weights, languages of a question's answers, sentence
ends) are counted over all pairs; only the language classifier is fitted on a
bounded sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import stage

#: An opening is compared as a set of words, so that from nine words on a
#: similarity of 0.8 allows a word in another's place.
OPENING = 16
SIMILARITY = 0.8
#: Eight bands of three: two openings at 0.8 share a bucket with a probability of 0.997.
HASHES = 24
BAND_ROWS = 3
#: Summed log odds from which an opening's words are those of a refusal.
REFUSAL_WEIGHT = math.log(1_000)
#: Documents (of smallest hash) that the language classifier is fitted on.
SAMPLE = 4_000
LANGUAGES = ("en", "de", "es", "fr", "nl")
LETTERS_TOLD = 16
#: Log odds over the second language from which one is named.
MARGIN = math.log(1_000)
#: A word ends sentences if it does so at least this often and with this share.
ENDS = 2
END_SHARE = 0.02
#: A whole response that recurs over so many prompts is no accident of cutting.
RECURS = 3
COPY_SIMILARITY = 0.85
#: Marks that a length limit leaves at the end of a text.
CUT_MARKS = r"<\W*(max[_ ]?tokens|length|truncated|eos|end of text)\W*>?$|\[(truncated|cut off)$"

# What stands for nothing, and how programs report failures.
PLACEHOLDERS = ("null", "none", "nil", "nan", "n/a", "na", "undefined", "empty", "no response", "no answer", "tbd", "todo", "pending")
ERROR_FORMS = (
    r"error\W*$",
    r"\[error\]",
    r"error (code )?\d{3}",
    r"http (error )?\d{3}",
    r"error\s*:",
    r"traceback \(",
    r"([a-z_]\w*\.)*[a-z_]\w*(error|exception)\s*:",
    r"cuda (error|out of memory)",
    r"(fatal|exception|failed)\s*:",
    r"segmentation fault",
)
# Closed-class words by which a speaker names itself, and by which something is denied, in the five languages.
SELF = (
    "i i'm i'd i've i'll me my our we ich mir mich mein meine meiner meinen meinem meines bin darf kann "
    "yo me mi mis puedo siento je j'ai mon ma mes moi suis ik mij mijn"
).split()
DENY = (
    "not no never cannot can't couldn't won't wouldn't don't isn't unable decline refuse nicht kein keine keinen keiner "
    "nunca ne pas jamais niet geen nooit"
).split()


# straight forms of curly apostrophes and quotes; blanks for invisible signs
_SIGNS = (
    "\u2019\u2018`\u00b4" + "\u201c\u201d\u201e\u00ab\u00bb" + "\u00a0\u200b\ufeff\u2060",
    "'" * 4 + '"' * 5 + " " * 4,
)


def plain(text: Column) -> Column:
    """Lower case, straight apostrophes, one space between words, no markup at the ends."""
    text = F.lower(text)
    # the grave accent is the only one of the signs within ASCII
    signs = (F.octet_length(text) != F.length(text)) | text.contains("`")
    text = F.when(signs, F.translate(text, *_SIGNS)).otherwise(text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words_of(text: Column) -> Column:
    """Words (letters, digits, inner apostrophes) of plain text."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*)"), 1)


def is_empty(text: Column) -> Column:
    """Plain text that is null, blank, only signs, or only a placeholder."""
    return text.isNull() | ~text.rlike(r"[\p{L}\p{N}]") | text.rlike(rf"^[^\p{{L}}\p{{N}}]*(?:{'|'.join(PLACEHOLDERS)})[^\p{{L}}\p{{N}}]*$")


def is_error(text: Column) -> Column:
    """Plain text that is a program's failure message."""
    # with the anchor outside the alternatives, no place but the beginning is tried
    return text.rlike(rf"^\W*(?:{'|'.join(ERROR_FORMS)})")


def without_frame(text: Column) -> Column:
    """Words of plain text without a label before and an empty answer slot after."""
    inner = F.regexp_replace(text, r"^\W*(question|user|prompt|q|frage|pregunta|instruction)\s*:", "")
    inner = F.regexp_replace(inner, r"\b(answer|assistant|a|antwort|respuesta)\s*:\W*$", "")
    text = F.when(text.contains(":"), inner).otherwise(text)
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def is_copy(text: Column, question: Column) -> Column:
    """Framed-off text that is only the question, once or twice, nearly unchanged."""

    def like(a: Column, b: Column) -> Column:
        # the length test first, so that the distance is only taken of near-equal lengths, in a band of what is allowed
        room = F.floor((1 - COPY_SIMILARITY) * F.greatest(F.length(a), F.length(b))).cast("int")
        return (F.abs(F.length(a) - F.length(b)) <= room) & (F.call_function("levenshtein", a, b, room) >= 0)  # -1 beyond

    return F.coalesce((F.length(question) > 0) & (like(text, question) | like(text, F.concat_ws(" ", question, question))), F.lit(False))


def outside_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r'"[^"]*("|$)', " ")


def opening_of(text: Column) -> Column:
    """The first ``OPENING`` words of a plain text."""
    # where quotes were taken out, blanks lie together
    text = F.trim(F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text))
    return F.slice(words_of(F.substring_index(text, " ", 2 * OPENING)), 1, OPENING)


def _whole_word(listed: list[str]) -> str:
    """Pattern of any of the words; most places are passed over at their first letter."""
    rests = {}
    for word in listed:
        rests.setdefault(word[0], []).append(word[1:])
    return rf"\b(?=[{''.join(rests)}])(?:{'|'.join(f'{a}(?:{"|".join(b)})' for a, b in rests.items())})\b"


def later_first_person(outside: Column) -> Column:
    """From the first sentence after the first that speaks in the first person; NULL without one."""
    person = _whole_word(SELF)
    later = F.regexp_extract(outside, rf"[.!?:;]\s([^.!?:;]*{person}.*)$", 1)
    return F.when(outside.rlike(person), F.nullif(later, F.lit("")))


def _any_of(words: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))


# ----------------------------------------------------------- opening clusters


def _signature(words: Column, i: int) -> Column:
    return F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(i))))


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(key, cluster): ``openings`` (key, opening as an array of words, used
    ``n`` times) with the key of every head they are verified to be like.

    Openings in one band bucket are compared with the bucket's most used one
    (its head, the smaller key of equals) only, so a bucket of n costs n
    comparisons. An opening lies in the cluster of each head it is like. Only
    keys are shuffled by bucket; words are fetched for pairs of two openings.
    """
    sets = openings.select("key", "n", F.array_distinct("opening").alias("words")).where(F.size("words") > 0)
    sig = F.array(*[_signature(F.col("words"), i) for i in range(HASHES)])
    bands = [F.xxhash64(F.lit(b), F.slice("sig", b * BAND_ROWS + 1, BAND_ROWS)) for b in range(HASHES // BAND_ROWS)]
    # the minima are the costly part and used twice
    banded = stage(sets.select("key", (-F.col("n")).alias("rank"), sig.alias("sig")).select("key", "rank", F.array(*bands).alias("buckets")), "bands")
    keyed = banded.select("key", "rank", F.explode("buckets").alias("bucket"))
    heads = keyed.groupBy("bucket").agg(F.min(F.struct("rank", "key")).alias("head")).select("bucket", F.col("head.key").alias("cluster"))
    pairs = stage(keyed.select("key", "bucket").join(heads, "bucket").select("key", "cluster").distinct(), "bucket-pairs")
    two = pairs.where("key <> cluster").join(sets.select("key", "words"), "key").join(sets.select(F.col("key").alias("cluster"), F.col("words").alias("head")), "cluster")
    common = F.size(F.array_intersect("words", "head"))
    like = F.try_divide(common, F.size("words") + F.size("head") - common)
    return pairs.where("key = cluster").unionByName(two.where(like >= SIMILARITY).select("key", "cluster"))


def refusing_openings(openings: DataFrame) -> DataFrame:
    """(key,) of the ``openings`` (key, opening, n, and the least and the
    greatest prompt cluster ``lo`` and ``hi`` they answer) that are refusals."""
    clusters = stage(opening_clusters(openings), "clusters")
    own, denies = _any_of(F.col("opening"), SELF), _any_of(F.col("opening"), DENY)
    marked = clusters.join(openings.select("key", "n", "lo", "hi", (own & denies).alias("declines")), "key")
    templates = marked.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("declines"), F.col("n")).otherwise(0)).alias("declined"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    seeds = stage(templates.where("lo <> hi AND 2 * declined >= n").select("cluster"), "templates")
    members = clusters.join(seeds, "cluster", "left_semi").select("key").distinct().withColumn("seed", F.lit(True))
    members = openings.select("key", "opening").join(members, "key", "left").withColumn("seed", F.coalesce("seed", F.lit(False))).withColumn("own", own)
    members = stage(members, "members")

    # what is undecided teaches neither side
    known = members.where("seed OR NOT own")
    words = known.select(F.explode(F.array_distinct("opening")).alias("word"), "seed")
    counted = words.groupBy("word").agg(F.count_if("seed").alias("in_seeds"), F.count_if(~F.col("seed")).alias("elsewhere"))
    sizes = known.agg(F.count_if("seed").alias("r"), F.count_if(~F.col("seed")).alias("o"))
    total = sizes.select(F.log((F.col("o") + 1) / (F.col("r") + 1))).scalar()
    weights = counted.select("word", (F.log((F.col("in_seeds") + 0.5) / (F.col("elsewhere") + 0.5)) + total).alias("weight"))
    # what does not speak in the first person is no refusal, whatever its words
    asked = members.where("NOT seed AND own").select("key", F.explode(F.array_distinct("opening")).alias("word"))
    heavy = asked.join(weights, "word").groupBy("key").agg(F.sum("weight").alias("weight")).where(F.col("weight") > REFUSAL_WEIGHT).select("key")
    return members.where("seed").select("key").unionByName(heavy)


# ------------------------------------------------------------------ language


class LanguageModel:
    """Naive Bayes over letter trigrams of words."""

    def __init__(self, texts: list[str], labels: list[str]):
        self._fit(texts, labels)
        # labels may be wrong: fit again on the texts that the first fit reads as labelled
        told = self.tell_words([self.words_of(t) for t in texts], 0.0)
        kept = [i for i, (a, b) in enumerate(zip(told, labels, strict=True)) if a in (b, None)]
        if len({labels[i] for i in kept}) == len(set(labels)):
            self._fit([texts[i] for i in kept], [labels[i] for i in kept])

    def _fit(self, texts: list[str], labels: list[str]) -> None:
        counts = {k: Counter() for k in LANGUAGES}
        for text, label in zip(texts, labels, strict=True):
            counts[label].update(self.trigrams(text))
        kept = {g for c in counts.values() for g, n in c.items() if n >= 2}
        total = np.array([sum(c[g] for g in kept) + 0.5 * len(kept) + 1 for c in counts.values()])
        self.weights = {g: np.log((np.array([c[g] for c in counts.values()]) + 0.5) / total) for g in kept}
        self.rare = np.log(0.5 / total)
        self.forget()

    def forget(self) -> None:
        """Drop the kept word scores (rows of ``scores``: one per language, then the letters)."""
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES) + 1))

    @staticmethod
    def words_of(text: str) -> list[str]:
        return re.findall(r"[^\W\d_]+", text.lower())

    @classmethod
    def trigrams(cls, text: str) -> list[str]:
        out = []
        for word in cls.words_of(text):
            padded = f" {word} "
            out += [padded[i : i + 3] for i in range(len(padded) - 2)]
        return out

    def word_scores(self, word: str) -> np.ndarray:
        return sum((self.weights.get(g, self.rare) for g in self.trigrams(word)), np.zeros(len(LANGUAGES)))

    def _learn(self, word: str) -> int:
        at = self.known[word] = len(self.known)
        if at == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[at, :-1] = self.word_scores(word)
        self.scores[at, -1] = len(word)
        return at

    def tell_words(self, rows: list[list[str]], margin: float = MARGIN) -> list[str | None]:
        """Language of each list of lower-case words; None if it has too few
        letters or another language is too near."""
        if len(self.known) > 200_000:
            self.forget()
        known = self.known
        flat = [known[w] if w in known else self._learn(w) for row in rows for w in row]
        sizes = np.array([len(row) for row in rows], dtype=np.int64)
        out = np.full(len(rows), None, dtype=object)
        full = np.flatnonzero(sizes)
        if len(full):
            sums = np.add.reduceat(self.scores[np.array(flat)], np.cumsum(sizes[full]) - sizes[full], axis=0)
            ranked = np.sort(sums[:, :-1], axis=1)
            sure = (sums[:, -1] >= LETTERS_TOLD) & (ranked[:, -1] - ranked[:, -2] > margin)
            out[full[sure]] = np.array(LANGUAGES, dtype=object)[sums[sure, :-1].argmax(1)]
        return out.tolist()

    def tell_all(self, texts: pd.Series, margin: float = MARGIN) -> pd.Series:
        """Language of each text, in slices of bounded size."""
        out: list[str | None] = []
        for low in range(0, len(texts), 1024):
            out += self.tell_words([self.words_of(t) if isinstance(t, str) else [] for t in texts.iloc[low : low + 1024]], margin)
        return pd.Series(out, dtype=object)

    def tell(self, text: str | None, margin: float = MARGIN) -> str | None:
        return self.tell_words([self.words_of(text or "")], margin)[0]


def fit_languages(documents: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Classifier from at most ``sample`` documents with a known language label
    (those of smallest hash, an equal share of each language)."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    known = documents.select("text", lang.alias("lang")).where(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 40))
    # one scan: a share by hash that leaves some ten times the sample, then the smallest hashes of each language
    share = min(1.0, 10 * sample / max(1, documents.count()))
    drawn = known.withColumn("_h", F.xxhash64("text")).where(F.pmod("_h", F.lit(1_000_000)) < round(share * 1_000_000))
    by = Window.partitionBy("lang").orderBy("_h", "text")
    rows = drawn.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= sample // len(LANGUAGES)).select("text", "lang").collect()
    return LanguageModel([r["text"] for r in rows], [r["lang"] for r in rows])


# ---------------------------------------------------------------- termination


def _last(text: Column) -> Column:
    """The last signs of a text: enough for a pattern of three signs at the end, without reading the rest."""
    return F.substring(text, -8, 8)


def _tail(text: Column) -> Column:
    """Plain text without closing quotes, brackets, markup and blanks."""
    closing = r"[\s\"'*_)\]]+$"
    return F.when(_last(text).rlike(closing), F.regexp_replace(text, closing, "")).otherwise(text)


def _last_word(tail: Column) -> Column:
    """The last word of a tail, blank without one; a word is tried from its beginning only."""
    return F.regexp_extract(F.substring(tail, -80, 80), r"(?<![\p{L}\p{N}'])([\p{L}\p{N}']++)\W*+$", 1)


def _is_cut(tail: Column) -> Column:
    marks = tail.contains("<") | tail.contains("[")
    return (marks & tail.rlike(CUT_MARKS)) | _last(tail).rlike(r"\p{L}-$")


def _is_stopped(tail: Column) -> Column:
    last = _last(tail)
    return last.rlike(r"[.!?\u2026:;\u3002]$|[:;][-']?[)(dp]$") & ~last.rlike(r"(\.\.\.|\u2026)$")


def sentence_ends(texts: DataFrame) -> DataFrame:
    """(word,): words of all ``text`` (plain) that end sentences often enough."""
    # no token goes over a blank, so the pattern need only read the distinct parts between blanks
    parts = texts.select(F.explode(F.split("text", " ")).alias("part")).groupBy("part").agg(F.count("*").alias("uses"))
    token = F.explode(F.regexp_extract_all("part", F.lit(r"([\p{L}\p{N}']+[\"*)]*(?:[.!?;](?![.\u2026]))?)"), 1)).alias("token")
    tokens = parts.select(token, "uses").groupBy("token").agg(F.sum("uses").alias("uses"))
    ends = F.when(F.col("token").rlike("[.!?;]$"), F.col("uses")).otherwise(0)
    words = tokens.groupBy(F.regexp_extract("token", r"^([\p{L}\p{N}']+)", 1).alias("word")).agg(F.sum(ends).alias("ends"), F.sum("uses").alias("uses"))
    return words.where((F.col("ends") >= ENDS) & (F.col("ends") >= END_SHARE * F.col("uses"))).select("word")


def defective_pairs(pairs: DataFrame, documents: DataFrame, languages: LanguageModel | None = None) -> DataFrame:
    """(pair_table, pair_id, defect) of every defective pair; at most one per pair.

    ``pairs`` has pair_table, pair_id, question and text. A pair counts once;
    a null or blank answer is 'empty'; a null question is like no copy and has
    no language. Defects are tried in the order empty, error, copy, refusal,
    other_language, truncated. Other columns are ignored.
    """
    model = pairs.sparkSession.sparkContext.broadcast(languages or fit_languages(documents))

    @F.pandas_udf("string")
    def language(text: pd.Series) -> pd.Series:
        return model.value.tell_all(text)

    rows = pairs.select("pair_table", "pair_id", "question", "text").where("pair_id IS NOT NULL").dropDuplicates(["pair_table", "pair_id"])
    # each form of a text is a column of its own, so that it is made once
    rows = rows.select("pair_table", "pair_id", "question", F.col("text").alias("raw"), plain(F.col("text")).alias("text"), plain(F.col("question")).alias("plain_question"))
    text = F.col("text")
    rows = rows.select(
        "*",
        without_frame(text).alias("bare"),
        without_frame(F.col("plain_question")).alias("bare_question"),
        outside_quotes(text).alias("outside"),
        _tail(text).alias("tail"),
    )
    early = F.when(is_empty(text), "empty").when(is_error(text), "error").when(is_copy(F.col("bare"), F.col("bare_question")), "copy")
    rows = rows.withColumns({"early": early, "late_part": later_first_person(F.col("outside"))})
    rows = rows.withColumns({"opening": opening_of(F.col("outside")), "late": F.when(F.col("late_part").isNotNull(), opening_of(F.col("late_part")))})
    tail = F.col("tail")
    # everything that is read from a text alone is read once and written
    read = stage(
        rows.select(
            "pair_table",
            "pair_id",
            "early",
            F.xxhash64("question").alias("asked"),
            "question",
            text.alias("text"),
            F.col("opening"),
            F.xxhash64("opening").alias("key"),
            F.col("late"),
            F.when(F.col("late").isNotNull(), F.xxhash64("late")).alias("late_key"),
            # only an answer without a closing stop is judged by its last word
            F.when(~_is_stopped(tail), _last_word(tail)).alias("last_word"),
            _is_cut(tail).alias("cut"),
            _is_stopped(tail).alias("stopped"),
            language(F.when(F.col("early").isNull(), F.col("raw"))).alias("answered_in"),
        ),
        "pairs",
    )
    answers = read.where("early IS NULL")

    asked = answers.where("question IS NOT NULL").groupBy("asked").agg(F.first("question").alias("question"))
    asked = stage(asked.withColumn("named", language("question")), "questions")
    # prompts alike lie in one cluster; one without words is in none
    prompt_words = asked.select("asked", F.array_distinct(words_of(plain(F.col("question")))).alias("opening"))
    prompt_words = prompt_words.withColumn("key", F.xxhash64("opening"))
    prompts = opening_clusters(prompt_words.groupBy("key").agg(F.first("opening").alias("opening"), F.count("*").alias("n")))
    prompts = prompt_words.select("asked", "key").join(prompts.groupBy("key").agg(F.min("cluster").alias("prompt")), "key")
    prompts = stage(prompts.select("asked", "prompt"), "prompts")
    votes = answers.where("answered_in IS NOT NULL").groupBy("asked", "answered_in").agg(F.count("*").alias("n"))
    votes = votes.groupBy("asked").agg(F.max_by("answered_in", F.struct("n", "answered_in")).alias("most"), F.max("n").alias("n"), F.sum("n").alias("all"))
    voted = F.when(2 * F.col("n") > F.col("all"), F.col("most"))
    languages_asked = stage(asked.join(votes, "asked", "left").select("asked", F.coalesce("named", voted).alias("asked_in")), "asked-in")

    keyed = answers.select("asked", F.explode(F.array_compact(F.array("opening", "late"))).alias("opening")).where(F.size("opening") > 0)
    keyed = keyed.groupBy("opening", "asked").agg(F.count("*").alias("n")).join(prompts, "asked", "left")
    by_opening = keyed.groupBy("opening").agg(F.sum("n").alias("n"), F.min("prompt").alias("lo"), F.max("prompt").alias("hi"))
    by_opening = stage(by_opening.withColumn("key", F.xxhash64("opening")), "openings")
    refusing = stage(refusing_openings(by_opening).distinct(), "refusing")

    ends = stage(sentence_ends(answers.select("text")).select(F.col("word").alias("last_word"), F.lit(True).alias("final")), "ends")
    # only answers without a closing stop can be cut, and only those need more statistics
    open_ended = ~F.col("stopped") & (F.col("last_word") != "")
    whole = answers.where(open_ended).select(F.xxhash64("text").alias("text_hash"), "asked").distinct().groupBy("text_hash").agg(F.count("*").alias("prompts"))
    whole = whole.where(F.col("prompts") >= RECURS).select("text_hash", F.lit(True).alias("recurs"))
    told = (
        answers.select("pair_table", "pair_id", "asked", "last_word", "cut", "stopped", "answered_in", F.xxhash64("text").alias("text_hash"), "key", "late_key")
        .join(refusing.withColumn("refuses", F.lit(True)), "key", "left")
        .join(refusing.select(F.col("key").alias("late_key"), F.lit(True).alias("refuses_late")), "late_key", "left")
        .join(languages_asked, "asked", "left")
        .join(whole, "text_hash", "left")
        .join(ends, "last_word", "left")
    )
    broken = F.col("cut") | (open_ended & F.col("final").isNull() & F.col("recurs").isNull())
    defect = (
        F.when(F.col("refuses") | F.col("refuses_late"), "refusal")
        .when(F.col("asked_in") != F.col("answered_in"), "other_language")
        .when(broken, "truncated")
    )
    found = told.withColumn("defect", defect).where("defect IS NOT NULL").select("pair_table", "pair_id", "defect")
    return read.where("early IS NOT NULL").select("pair_table", "pair_id", F.col("early").alias("defect")).unionByName(found)
