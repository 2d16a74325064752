"""Speaker labels of transcribed speech."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a label of one of three speakers is spelled.
LABEL = r"(?:speaker|spk|participant|part|p)[\s\u00a0_.-]*0*([1-3])"
LETTER = r"([abc])"
_BLANK = r"[\s\u00a0]"
#: What may stand before an inline label: stamps in any brackets, arrows, markers.
BEFORE_LABEL = r"^(?:\s|>|[\[({<]?\d[\d:.,]*\s*s?[\])}>]?(?=[\s\[>])|-->)*"
INLINE = rf"(?i){BEFORE_LABEL}(?:\[\s*(?:{LABEL}|{LETTER})\s*\]|(?:{LABEL}\s*(?::|-(?=\s))|{LETTER}\s*:))"


def canonical_speaker(label: Column) -> Column:
    """p1, p2 or p3 for any spelling of a label (1/A, 2/B, 3/C); else NULL."""
    text = F.lower(label)
    digit = F.regexp_extract(text, rf"^{_BLANK}*{LABEL}{_BLANK}*$", 1)
    bare = F.regexp_extract(text, rf"^{_BLANK}*0*([1-3]){_BLANK}*$", 1)
    letter = F.regexp_extract(text, rf"^{_BLANK}*(?:speaker{_BLANK}+)?{LETTER}{_BLANK}*$", 1)
    number = F.when(digit != "", digit).when(letter != "", F.translate(letter, "abc", "123")).when(bare != "", bare)
    return F.concat(F.lit("p"), number)


def inline_speaker(transcript: Column) -> Column:
    """Speaker that a transcript's own opening label names, else NULL."""
    found = [F.regexp_extract(transcript, INLINE, i) for i in (1, 2, 3, 4)]
    label = F.lower(F.coalesce(*[F.when(x != "", x) for x in found]))
    return F.concat(F.lit("p"), F.translate(label, "abc", "123"))


def file_speaker(file_id: Column) -> Column:
    """Speaker that the end of a file id names (``..._A``), else NULL."""
    return canonical_speaker(F.nullif(F.regexp_extract(file_id, r"_([^_]+)\s*$", 1), F.lit("")))


def utterance_speaker(role: Column, transcript: Column, file_id: Column) -> Column:
    """From the role, else the inline label, else the end of the file id."""
    return F.coalesce(canonical_speaker(role), inline_speaker(transcript), file_speaker(file_id))
