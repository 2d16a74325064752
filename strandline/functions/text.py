"""String, path and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks the text of a failed response.
ERROR_PREFIX = "[ERROR]"
OUT_OF_MEMORY = r"(?i)(cuda.*out of memory|outofmemoryerror|torch\.cuda\..*outofmemory|cuda out of memory)"


def is_error_text(text: Column) -> Column:
    """Trimmed text starts with the error mark, or reports lack of GPU memory."""
    return F.coalesce(F.trim(text).startswith(ERROR_PREFIX) | text.rlike(OUT_OF_MEMORY), F.lit(False))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """Captured group; NULL where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def trailing_number(text: Column, default: int | None = None) -> Column:
    """Integer at the end of a text."""
    number = group(text, r"(\d+)$").try_cast("bigint")
    return number if default is None else F.coalesce(number, F.lit(default).cast("bigint"))


def clip_prefix(identifier: Column) -> Column:
    """``d3u1`` of ``d3u1_clip_2`` and ``d3u1_clip2``."""
    return group(identifier, r"^(.*?)_clip_?\d+$")


def clip_index(identifier: Column, strict: bool = False) -> Column:
    """Number of the clip; ``strict`` knows the spelling without underscore only."""
    return group(identifier, r"_clip(\d+)$" if strict else r"_clip_?(\d+)$").cast("int")


def media_layout(path: Column) -> dict[str, Column]:
    """Columns of a media path; the scheme of a URL is cut first."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/", "")
    name = group(bare, r"([^/]+)$")
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return {
        "task": group(bare, r"/?(task\d+)/"),
        "batch": group(bare, r"/b(\d+)/").cast("int"),
        "dialogue": group(stem, r"^d(\d+)u\d+").cast("int"),
        "utterance": group(stem, r"^d\d+u(\d+)").cast("int"),
        "clip_prefix": clip_prefix(stem),
        "clip_index": clip_index(stem),
        "extension": F.lower(group(name, r"\.([^.]+)$")),
    }


# How annotated media lie in folders, and how recordings are named.
FILE_ID = r"^(V\d+)_S(\d+)_I(\d+)_P([A-Za-z0-9]+)$"
DIALOGUE_FILE = r"^dia(\d+)_utt(\d+)$"
ANCHOR = r"^d(\d+)u(\d+)$"
CAMERA_FILE = r"^cam(\d+)_vid(\d+)_seg(\d+)$"
TASKS = ("affordance", "intention")
# A served model, labelled by its mode, and one that has a single size.
SERVED_MODEL = "gemini"
UNSIZED_MODEL = "ming-lite-omni"


def group_layout(path: Column) -> dict[str, Column]:
    """Columns of an annotated clip's path ``.../u2/<dataset>_u2b3/<group>/<prefix>_clip_1.mp4``."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    place = r"(?:^|/)u([123])/([^/]+)_u([123])b(\d+)/"
    name = group(bare, r"([^/]+)$")
    prefix = group(name, r"^(.+)_clip_?\d+\.[^.]+$")
    inner = group(bare, r"(?:^|/)u[123]/[^/]+_u[123]b\d+/(.*)/[^/]+$")
    return {
        "utt_count": group(bare, place, 1).cast("int"),
        "dataset_name": group(bare, place, 2),
        "batch_name": group(bare, r"(?:^|/)u[123]/([^/]+_u[123]b\d+)/"),
        "group_name": group(inner, r"^([^/]+)"),
        "clip_prefix": prefix,
        "clip_index": group(name, r"_clip_?(\d+)\.[^.]+$").cast("int"),
        "group_identifier": F.when(group(bare, place, 1).isNotNull() & prefix.isNotNull(), F.concat_ws("/", inner, prefix)),
    }


def file_id_parts(stem: Column) -> dict[str, Column]:
    """Parts of ``V00_S0926_I00000480_P0092A`` and the id of its interaction."""
    vendor, session, interaction, participant = (group(stem, FILE_ID, i) for i in (1, 2, 3, 4))
    return {
        "vendor": vendor,
        "session": session,
        "interaction": interaction,
        "participant": participant,
        "interaction_id": F.concat(vendor, F.lit("_S"), session, F.lit("_I"), interaction),
    }


def dialogue_and_utterance(stem: Column) -> Column:
    """Struct(dialogue, utterance) of ``dia1_utt2`` or ``d1u2``; NULL for others."""
    forms = [F.when(stem.rlike(p), F.struct(group(stem, p, 1).cast("int").alias("dialogue"), group(stem, p, 2).cast("int").alias("utterance"))) for p in (DIALOGUE_FILE, ANCHOR)]
    return F.coalesce(*forms)


def camera_segment(stem: Column) -> Column:
    """Struct(camera, video, segment) of ``cam2_vid2_seg7``; NULL for others."""
    parts = [group(stem, CAMERA_FILE, i).cast("int").alias(n) for i, n in enumerate(("camera", "video", "segment"), 1)]
    return F.when(stem.rlike(CAMERA_FILE), F.struct(*parts))


def group_size(path: Column) -> Column:
    """Size of the first folder like ``2-utt_group``."""
    return group(path, r"(?:^|/)([123])-utt_group(?:/|$)").cast("int")


def task_name(folder: Column) -> Column:
    """The first task that a folder's own name holds, in any case."""
    leaf = F.lower(group(folder, r"([^/]+)/?$"))
    return F.coalesce(*[F.when(leaf.contains(t), t) for t in TASKS])


def model_label(model: Column, folder: Column) -> Column:
    """Label of a result folder's model: its size is added in capitals if the
    folder's name has one; of a served model the mode before the task, if the
    name ends so; a model whose size is fixed keeps its name."""
    leaf = group(folder, r"([^/]+)/?$")
    size = F.upper(group(leaf, r"(\d+[Bb])(?:[_-]|$)"))
    mode = group(leaf, rf"^(.*)_(?i:{'|'.join(TASKS)})_(?i:single-turn)$")
    served = F.when(mode.isNotNull(), F.concat(model, F.lit("-"), mode)).otherwise(model)
    sized = F.when(size.isNotNull(), F.concat(model, F.lit("-"), size)).otherwise(model)
    return F.when(F.lower(model) == SERVED_MODEL, served).when(F.lower(model).contains(UNSIZED_MODEL), model).otherwise(sized)


def sanitise_label(text: Column) -> Column:
    """Every run of signs other than letters, digits, dot, underscore and hyphen as one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def safe_name(text: Column) -> Column:
    """The same, without underscores at the ends."""
    return F.regexp_replace(sanitise_label(text), r"^_+|_+$", "")


def display_label(name: Column, labels: dict[str, str]) -> Column:
    """The label of a name; a name without one stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), name), name)


def turn_prompt(turn: Column, first: Column, later: Column) -> Column:
    """Prompt of a turn, counted from 0; a blank one is NULL."""
    return F.nullif(F.trim(F.when(turn == 0, first).otherwise(later)), F.lit(""))


def sanitise(text: Column, fallback: str = "record") -> Column:
    """Safe file name part."""
    safe = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
    safe = F.regexp_replace(safe, r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def pad_single_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![0-9])([0-9])(?![0-9])", "0$1")


def rebase(path: Column, prefixes: dict[str, str]) -> Column:
    """Replace the first matching prefix; percent escapes are decoded."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    out = None
    for old, new in prefixes.items():
        moved = F.concat(F.lit(new), F.substring(plain, len(old) + 1, 1 << 20))
        out = (F.when if out is None else out.when)(plain.startswith(old), moved)
    return plain if out is None else out.otherwise(plain)


def int_tuples(text: Column) -> Column:
    """``(3, 20), (4, x)`` -> [[3, 20]]: tuples of integers, others ignored."""
    inner = F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), 1)
    parsed = F.transform(inner, lambda t: F.transform(F.split(t, ","), lambda x: F.trim(x).try_cast("int")))
    return F.filter(parsed, lambda t: ~F.exists(t, lambda x: x.isNull()))


def camera_groups(text: Column) -> Column:
    """``(<1,2>, cam4)(<5>, cam6)`` -> array of (camera, ids)."""
    ids = F.regexp_extract_all(text, F.lit(r"\(<([0-9, ]*)>\s*,\s*cam(\d+)\)"), 1)
    cams = F.regexp_extract_all(text, F.lit(r"\(<([0-9, ]*)>\s*,\s*cam(\d+)\)"), 2)
    return F.zip_with(cams, ids, lambda c, i: F.struct(c.cast("int").alias("camera"), F.transform(F.split(i, ","), lambda x: F.trim(x).try_cast("int")).alias("ids")))


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` places; places without a value stay as they are."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("{" + name + "}")))
    return out


def join_prompts(system: Column, user: Column) -> Column:
    """System and user text with a blank line between; a blank system is left out."""
    return F.concat_ws("\n\n", F.nullif(F.trim(system), F.lit("")), F.trim(user))


def mean_with_error(mean: Column, error: Column) -> Column:
    """``0.123 ± 0.045``; blank where the mean is missing."""
    return F.when(mean.isNull(), "").otherwise(F.concat(F.format_string("%.3f", mean), F.lit(" ± "), F.format_string("%.3f", F.coalesce(error, F.lit(0.0)))))


def strip_special_tokens(text: Column) -> Column:
    """Without chat markers such as ``<|im_end|>`` or ``</s>``."""
    return F.trim(F.regexp_replace(text, r"<\|[^|<>]*\|>|</?s>|<(?:bos|eos|pad|unk)>|<(?:start|end)_of_turn>", ""))
