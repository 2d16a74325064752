"""Problem 7: raw transcripts into clean, ordered speaker turns.

Every token of a transcript gets one of five labels (speaker, timestamp,
annotation, filler, speech) from a hidden Markov model decoded by Viterbi. An
observation is what a token is (its word, or a class for times, hesitations
and labels before any word) and the kind of bracket it stands in; transitions have one matrix inside a bracket and one outside. The
model starts from labels that only forms without doubt get (words in square
brackets, words outside brackets, ...) and is then re-estimated from its own
decoding, which settles words in round brackets: a sound note, or speech. A
transcript's own speaker label is its first token tagged as speaker.

It is fitted on at most ``SAMPLE`` transcripts, so its size is bounded; every
transcript is decoded.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.speech import canonical_speaker, file_speaker
from strandline.session import stage

#: Transcripts that the tagger is fitted on, chosen by hash.
SAMPLE = 20_000
ROUNDS = 2
PRIOR = 20

SPEAKER, STAMP, NOTE, FILLER, SPEECH = range(5)
CONTEXTS = ("none", "square", "curly", "angle", "star", "music", "double", "paren")
_OPEN = {"[": "square", "{": "curly", "<": "angle", "((": "double", "(": "paren"}
_CLOSE = {"]": "[", "}": "{", ">": "<", "))": "((", ")": "("}
_TOGGLE = {"*": "star", "♪": "music"}

TOKEN = re.compile(
    r"""(?P<time>\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?|\d+(?:\.\d+)?\s?s(?=\s*[>\])}]))
      |(?P<label>\b(?:speaker|spk|participant|part|p)[\s_.-]*0*[1-3](?=\s*[:\]]|\s*-\s)|\b[abc](?=\s*[:\]]))
      |(?P<arrow>-->|>>)
      |(?P<bracket>\(\(|\)\)|[\[\]{}<>()*♪])
      |(?P<word>[^\W_]+(?:['’ʼ‘`´][^\W_]+)*)""",
    re.IGNORECASE | re.VERBOSE,
)
#: uh, um, er, hm, mm and their spellings.
HESITATION = re.compile(r"u+h+m*|u+m+|e+r+m*|e+h+m+|h+m+|m{2,}")
SPOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
LETTERS = str.maketrans("abc", "123")
APOSTROPHES = str.maketrans({c: "'" for c in "’ʼ‘`´"})


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(observed form, bracket context, bracket number, words) of each token
    that can be a word; bracket number 0 is outside, words are lower case."""
    found: list[list] = []
    stack: list[tuple[str, int]] = []
    spans = 0
    for m in TOKEN.finditer(text):
        kind, piece = m.lastgroup, m.group()
        if kind == "arrow":
            continue
        if kind == "bracket":
            if piece in _TOGGLE or piece in _CLOSE:
                opener = piece if piece in _TOGGLE else _CLOSE[piece]
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == opener), None)
                if at is not None:
                    spans += 1
                    name = _TOGGLE.get(piece) or _OPEN[opener]
                    for token in found[stack[at][1] :]:
                        if not token[2]:
                            token[1], token[2] = CONTEXTS.index(name), spans
                    del stack[at:]
                    continue
            if piece in _TOGGLE or piece in _OPEN:
                stack.append((piece, len(found)))
            continue
        plain = piece.lower() if piece.isascii() else piece.lower().translate(APOSTROPHES)
        form = "#time" if kind == "time" else plain
        if kind == "word":
            if plain[0] in "uehm" and HESITATION.fullmatch(plain):
                form = "#hesitation"
        else:
            plain = " ".join(SPOKEN.findall(plain))
        found.append([form, 0, 0, plain, kind])
    out = []
    begun = False
    for form, context, span, plain, kind in found:
        out.append(("#label" if kind == "label" and not begun else form, context, span, plain))
        begun = begun or (kind == "word" and CONTEXTS[context] in ("none", "paren"))
    return out


def _sure(form: str, context: int) -> int | None:
    """Label of a token whose form leaves no doubt; None for words in round brackets."""
    if form == "#time":
        return STAMP
    if form == "#label":
        return SPEAKER
    if form == "#hesitation":
        return FILLER
    if context == 0:
        return SPEECH
    return None if CONTEXTS[context] == "paren" else NOTE


class Tagger:
    """Log probabilities of the hidden Markov model."""

    def __init__(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.unseen = np.zeros(5)
        self.context = np.zeros((5, len(CONTEXTS)))
        self.first = np.zeros(5)
        self.step = np.zeros((2, 5, 5))
        self.index: dict[str, int] | None = None
        self.table: np.ndarray | None = None

    @classmethod
    def fit(cls, texts: list[str]) -> Tagger:
        rows = [tokens(t) for t in texts]
        labels = [[_sure(f, c) for f, c, _, _ in row] for row in rows]
        model = cls._count(rows, labels)
        for _ in range(ROUNDS):
            model = cls._count(rows, model._decode(rows))
        return model

    @classmethod
    def _count(cls, rows: list, labels: list) -> Tagger:
        words: list[Counter] = [Counter() for _ in range(5)]
        # what these forms are is known before any transcript is seen
        for tag, form in ((SPEAKER, "#label"), (STAMP, "#time"), (FILLER, "#hesitation")):
            words[tag][form] = PRIOR
        context = np.full((5, len(CONTEXTS)), 0.5)
        context[SPEECH, CONTEXTS.index("paren")] += 1.0
        first, step = np.full(5, 0.5), np.full((2, 5, 5), 0.1)
        step[0] += 5.0
        step[1] += 4.0 * np.eye(5)
        for row, tags in zip(rows, labels, strict=True):
            last: tuple[int | None, int] = (None, 0)
            for i, ((form, c, span, _), tag) in enumerate(zip(row, tags, strict=True)):
                if tag is not None:
                    words[tag][form] += 1
                    context[tag, c] += 1
                    if i == 0:
                        first[tag] += 1
                    elif last[0] is not None:
                        step[int(span > 0 and span == last[1]), last[0], tag] += 1
                last = (tag, span)
        # one bracket holds either a note or speech
        step[1, SPEECH, NOTE] = step[1, NOTE, SPEECH] = 1e-5
        model = cls()
        vocabulary = set().union(*words)
        totals = np.array([sum(w.values()) for w in words], dtype=float) + 1.0
        model.words = {form: np.log((np.array([w[form] for w in words]) + 1e-3) / totals) for form in vocabulary}
        rare = np.array([sum(1 for n in w.values() if n == 1) for w in words]) + 0.1
        rare[[SPEAKER, STAMP, FILLER]] = 1e-6
        model.unseen = np.log(rare / totals / (len(vocabulary) + 1.0))
        model.context = np.log(context / context.sum(1, keepdims=True))
        model.first = np.log(first / first.sum())
        model.step = np.log(step / step.sum(2, keepdims=True))
        return model

    def _decode(self, rows: list) -> list[list[int]]:
        """Viterbi paths of all rows at once, those of like length together."""
        size = np.array([len(row) for row in rows], dtype=np.int64)
        begin = np.cumsum(size) - size
        unseen = len(self.words)
        index = {form: i for i, form in enumerate(self.words)} if self.index is None else self.index
        self.index = index
        table = np.array([*self.words.values(), self.unseen]) if self.table is None else self.table
        self.table = table
        forms = np.array([index.get(f, unseen) for row in rows for f, _, _, _ in row], dtype=np.int64)
        contexts = np.array([c for row in rows for _, c, _, _ in row], dtype=np.int64)
        spans = np.array([b for row in rows for _, _, b, _ in row], dtype=np.int64)
        observed = table[forms] + self.context.T[contexts]
        inside = np.zeros(len(spans), dtype=np.int64)
        inside[1:] = (spans[1:] > 0) & (spans[1:] == spans[:-1])
        out = np.zeros(len(forms), dtype=np.int64)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            longest = int(size[part].max())
            here = np.arange(longest) < size[part][:, None]
            places = np.where(here, begin[part][:, None] + np.arange(longest), begin[part][:, None])
            seen, same = observed[places], inside[places]
            score = self.first + seen[:, 0]
            back = np.zeros((len(part), longest, 5), dtype=np.int8)
            for t in range(1, longest):
                paths = score[:, :, None] + self.step[same[:, t]]
                back[:, t] = paths.argmax(1)
                score = np.where(here[:, t, None], paths.max(1) + seen[:, t], score)
            tag = score.argmax(1)
            path = np.zeros((len(part), longest), dtype=np.int64)
            each = np.arange(len(part))
            for t in range(longest - 1, -1, -1):
                path[:, t] = tag
                tag = np.where(here[:, t], back[each, t, tag], tag)
            out[places[here]] = path[here]
        flat = out.tolist()
        return [flat[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]

    def read(self, texts: list[str | None]) -> list[tuple[str, str | None]]:
        """Per transcript its spoken words, lower case, one space between, and
        the speaker (p1, p2, p3) of the first token tagged as one, else None."""
        out: list[tuple[str, str | None]] = []
        for low in range(0, len(texts), 2_048):
            rows = [tokens(t) if t else [] for t in texts[low : low + 2_048]]
            for row, tags in zip(rows, self._decode(rows), strict=True):
                label = next((plain for (_, _, _, plain), tag in zip(row, tags, strict=True) if tag == SPEAKER), None)
                speaker = f"p{label[-1].translate(LETTERS)}" if label and label[-1] in "123abc" else None
                out.append((" ".join([plain for (_, _, _, plain), tag in zip(row, tags, strict=True) if tag == SPEECH and plain]), speaker))
        return out

    def clean(self, texts: list[str | None]) -> list[str]:
        """Spoken words of each transcript."""
        return [text for text, _ in self.read(texts)]


def fit_tagger(utterances: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Tagger from at most ``sample`` transcripts (those of smallest hash)."""
    texts = utterances.where(F.length(F.trim("transcript")) > 0).select("transcript").distinct()
    picked = texts.orderBy(F.xxhash64("transcript"), "transcript").limit(sample)
    return Tagger.fit([r[0] for r in picked.collect()])


#: Seconds, or global positions, that one ordering chunk of an interaction spans.
CHUNK_SECONDS = 300.0
CHUNK_POSITIONS = 64


def speaker_turns(utterances: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(interaction_id, turn_no, speaker, turn_text), turns counted from 1.

    Utterances come in order of ``start_s``, or of ``global_index`` in an
    interaction that lacks any ``start_s``; ties by ``global_index``, then id.
    Re-delivered ids count once. Utterances left without spoken words, without
    an interaction or without a speaker that a label names are dropped before
    neighbours of one speaker join. No task orders a whole interaction: rows
    are ordered within chunks and chunks within interactions.
    """
    columns = ("utterance_id", "interaction_id", "speaker_role", "speaker_file_id", "global_index", "start_s", "transcript")
    rows = utterances.select(*columns).where("interaction_id IS NOT NULL").dropDuplicates(["utterance_id"])
    model = rows.sparkSession.sparkContext.broadcast(tagger or fit_tagger(utterances))

    @F.pandas_udf("text string, speaker string")
    def read(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.value.read([t if isinstance(t, str) else None for t in text]), columns=["text", "speaker"])

    start = F.when(~F.isnan("start_s"), F.col("start_s"))
    lacking = rows.groupBy("interaction_id").agg(F.max(start.isNull()).alias("lacks"))
    # read once and written: chunks and turns both use it
    spoken = rows.select("utterance_id", "interaction_id", "global_index", start.alias("start"), "speaker_role", "speaker_file_id", read("transcript").alias("said"))
    spoken = spoken.select(
        "utterance_id",
        "interaction_id",
        "global_index",
        "start",
        F.coalesce(canonical_speaker(F.col("speaker_role")), F.col("said.speaker"), file_speaker(F.col("speaker_file_id"))).alias("speaker"),
        F.col("said.text").alias("text"),
    )
    # filtered only after it is written: a filter on what the tagger gives would run it twice
    spoken = stage(spoken, "spoken").where("speaker IS NOT NULL AND text <> ''")
    placed = spoken.join(lacking.where("lacks"), "interaction_id", "left")
    by_index = F.coalesce(F.col("lacks"), F.lit(False))
    key = F.when(by_index, F.col("global_index").cast("double")).otherwise(F.col("start"))
    chunk = F.floor(F.when(by_index, key / CHUNK_POSITIONS).otherwise(key / CHUNK_SECONDS))
    placed = placed.select(
        "interaction_id",
        F.coalesce(chunk, F.lit(1 << 60)).alias("chunk"),
        F.struct(F.coalesce(key, F.lit(float("inf"))).alias("k"), F.col("global_index").alias("g"), F.col("utterance_id").alias("u")).alias("at"),
        "speaker",
        "text",
    )
    inside = Window.partitionBy("interaction_id", "chunk").orderBy("at")
    began = F.when(F.col("speaker") == F.lag("speaker").over(inside), 0).otherwise(1)
    local = placed.withColumn("began", began).withColumn("local", F.sum("began").over(inside))
    chunks = local.groupBy("interaction_id", "chunk").agg(
        F.min_by("speaker", "at").alias("first"), F.max_by("speaker", "at").alias("last"), F.max("local").alias("turns")
    )
    over = Window.partitionBy("interaction_id").orderBy("chunk")
    follows = F.coalesce((F.lag("last").over(over) == F.col("first")).cast("int"), F.lit(0))
    chunks = chunks.withColumn("follows", follows)
    new = F.sum(F.col("turns") - F.col("follows")).over(over)
    chunks = chunks.select("interaction_id", "chunk", (new - F.col("turns")).alias("shift"))
    numbered = local.join(chunks, ["interaction_id", "chunk"]).withColumn("turn_no", F.col("local") + F.col("shift"))
    turns = numbered.groupBy("interaction_id", "turn_no").agg(
        F.first("speaker").alias("speaker"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts")
    )
    return turns.select("interaction_id", F.col("turn_no").cast("long").alias("turn_no"), "speaker", F.array_join("parts.text", " ").alias("turn_text"))
