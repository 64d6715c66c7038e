"""One consistent form of visually identical texts.

Quick-check properties tell which characters may change under normalization.  Only segments
around such characters, widened to the base character before and the marks after them, are
normalized; the results are spliced into the text, which is otherwise passed on untouched.  What
kinds of variants a text holds follows from what the splices changed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic and Greek letters that the public list of confusable characters maps to
# one Latin letter, with that letter; first capitals, then small letters.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮЬԌԚԜѴӀ" "аеѕіјорсухүһԁԛԝѵӏгѡҽꙇ", "ABESIJKMHOPCTYXYbGQWVl" "aesijopcyxyhdqwvlrwei", strict=True))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϺͿ" "αγινορσυϳ", "ABEZHIKMNOPTYXFMJ" "ayivopouj", strict=True))


def _with_marks(letters: dict[str, str]) -> dict[str, str]:
    """``letters`` and those that are one of them joined with marks."""
    out = dict(letters)
    for code in [*range(0x370, 0x400), *range(0x400, 0x530), *range(0x1F00, 0x2000)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in letters:
            out[chr(code)] = unicodedata.normalize("NFC", letters[base] + "".join(marks))
    return out


LOOKALIKES = _with_marks(_CYRILLIC | _GREEK)

_LOOK = "".join(LOOKALIKES)
#: a joiner between two pictographs, possibly with a modifier or selector between
_PICTURE = r"\p{Extended_Pictographic}[\uFE0F\U0001F3FB-\U0001F3FF]?"
_UNSTABLE = r"[\p{NFKC_QC=No}\p{NFKC_QC=Maybe}\p{Cf}]"

_HINT = regex.compile(rf"(?V1){_UNSTABLE}|[{_LOOK}]")
_UNSTABLE_ANY = regex.compile(rf"(?V1){_UNSTABLE}")
#: a base with its marks, then unstable characters and all marks that follow them
_SEGMENT = regex.compile(rf"(?V1)(?:\P{{M}}\p{{M}}*)?(?:{_UNSTABLE}\p{{M}}*)+")
#: format characters but for a joiner between pictographs
_HIDDEN = regex.compile(rf"(?V1)[\p{{Cf}}--\p{{Prepended_Concatenation_Mark}}--\u200D]|(?<!{_PICTURE})\u200D|\u200D(?!\p{{Extended_Pictographic}})")
_WORD_CHAR = r"[\p{L}\p{M}\p{N}]"
_MIXED = regex.compile(rf"(?V1){_WORD_CHAR}*[{_LOOK}]{_WORD_CHAR}*")
_LATIN_CLASS = "A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿⱠ-ⱿꜢ-ꞇꞋ-ꟿ"
_LATIN = re.compile(f"[{_LATIN_CLASS}]")
_BETWEEN = rf"(?:[^\W_{_LATIN_CLASS}]|[\u0300-\u036F])*"
#: a Latin letter and a look-alike in one word, with no other Latin letter between them
_MIX_HINT = re.compile(f"[{_LATIN_CLASS}]{_BETWEEN}[{_LOOK}]|[{_LOOK}]{_BETWEEN}[{_LATIN_CLASS}]")
_FOLD = str.maketrans(LOOKALIKES)


@lru_cache(maxsize=1 << 16)
def _spliced(segment: str) -> tuple[str, bool, bool]:
    """(normal form, whether it makes compatibility forms plain, whether it joins marks) of a segment."""
    plain, joined = unicodedata.normalize("NFKC", segment), unicodedata.normalize("NFC", segment)
    shorter = joined != segment and len(joined) < len(segment)
    return plain, plain != joined or (joined != segment and not shorter), shorter


def examined(text: str) -> tuple[str, list[str]]:
    """(form, traits): the consistent form and the kinds of variants the text holds.

    Kinds in order: compatibility, apart (marks), invisible, lookalike.  The form has no invisible
    characters, compatibility forms made plain, marks joined, look-alike letters inside words with
    Latin letters made Latin.  It is stable, and has no traits; ASCII is unchanged.
    """
    if text.isascii() or not _HINT.search(text):
        return text, []
    compatibility = apart = lookalike = False
    bare = text
    if _UNSTABLE_ANY.search(text):
        bare = visible = _HIDDEN.sub("", text)

        def splice(match: regex.Match) -> str:
            nonlocal compatibility, apart
            plain, replaced, joined = _spliced(match.group())
            compatibility |= replaced
            apart |= joined
            return plain

        bare = _SEGMENT.sub(splice, visible)
        invisible = len(visible) < len(text)
    else:
        invisible = False

    def fold(match: regex.Match) -> str:
        nonlocal lookalike
        word = match.group()
        if not _LATIN.search(word):
            return word
        lookalike = True
        return unicodedata.normalize("NFC", word.translate(_FOLD))

    form = _MIXED.sub(fold, bare) if _MIX_HINT.search(bare) else bare
    kinds = (("compatibility", compatibility), ("apart", apart), ("invisible", invisible), ("lookalike", lookalike))
    return form, [kind for kind, there in kinds if there]


def canonical_marks(text: str) -> str:
    """Without invisible characters and in normal form: only unstable segments are normalized and spliced in."""
    if not _UNSTABLE_ANY.search(text):
        return text
    return _SEGMENT.sub(lambda m: _spliced(m.group())[0], _HIDDEN.sub("", text))


def canonical(text: str) -> str:
    """The consistent form."""
    return examined(text)[0]


def traits(text: str) -> list[str]:
    """Which kinds of variant the text holds."""
    return examined(text)[1]


def text_forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, changed, traits) of every row, in one pass.

    A null text has a null form, is unchanged and has no traits; an empty text stays empty.
    Rows with the same key are kept as they are; other columns are left out.  ASCII texts stay
    in their Arrow batches.
    """

    def forms(batches):
        for batch in batches:
            texts = batch.column(1)
            other = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
            treated = [examined(t) for t in texts.filter(other).to_pylist()]
            form = pc.replace_with_mask(texts, other, pa.array([f for f, _ in treated], texts.type))
            changed = pc.fill_null(pc.not_equal(form, texts), False)
            sizes = pa.array([len(k) for _, k in treated], pa.int32())
            counts = pc.replace_with_mask(pa.array([0] * len(texts), pa.int32()), other, sizes).to_numpy()
            offsets = pa.array([0, *counts.cumsum().tolist()], pa.int32())
            kinds = pa.ListArray.from_arrays(offsets, pa.array([k for _, ks in treated for k in ks], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), form, changed, kinds], names=[key, "form", "changed", "traits"])

    schema = T.StructType([documents.schema[key], T.StructField("form", T.StringType()), T.StructField("changed", T.BooleanType()), T.StructField("traits", T.ArrayType(T.StringType()))])
    return documents.select(key, text).mapInArrow(forms, schema)


def variant_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the texts that hold at least one variant character, each once; ASCII texts aren't sent to Python."""
    return text_forms(documents.where(F.col(text).rlike(r"[^\x00-\x7F]")), key, text).where(F.size("traits") > 0).select(key).distinct()
