"""Text functions of the content bank, as Column expressions.

Regular expressions are Unicode-aware (``(?U)``) wherever white space, word borders or
letter case of non-ASCII text matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters that fold to one ASCII letter, in code order.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore")) == 1 and d.isalpha())
_PLAIN = "".join(unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in _ACCENTED)



def _one_upper(c: str) -> str:
    return "ẞ" if c == "ß" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c)


# All letters with the one letter of their upper case.
_LOWER = "".join(c for c in map(chr, range(0x1F000)) if _one_upper(c) != c)
_UPPER = "".join(map(_one_upper, _LOWER))

# Roman numerals as tokens.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}

# Quotations, and marks that join separate pieces in one quotation.
QUOTED = "\"[^\"]+\"|'[^']+'|“[^”]+”|‘[^’]+’"
JOINS = r"\[(?U)\s*(?:\.\.\.|…)\s*\]|\.\.\.|…|•"

# Phrases that give away an unseen source, any format; in true/false items; in subjects without a support text.
SOURCE_PHRASES = (
    r"\b(?:trecho|texto) (?:fornecido|apresentado|transcrito)\b|\bo trecho (?:informa|indica|descreve)\b"
    r"|\b(?:descrit[oa]|mencionad[oa]|citad[oa]) no (?:trecho|coment[aá]rio)\b"
    r"|\bo coment[aá]rio (?:apresentado|citado|normativo)\b|\bconforme o coment[aá]rio\b"
    r"|\b(?:artigo|dispositivo) (?:indicado|mencionado|citado|em coment[oa])\b"
)
OPTION_PHRASES = (
    r"\boutras alternativas\b|\balternativa\s+[A-E]\b|\b[A-E]\)\s+(?:N[ãa]o|Errad|Incorret|Corret)"
    r"|\ba alternativa (?:erra|est[aá]|[ée] (?:incorreta|correta|errada|certa))\b"
)
TEXT_PHRASES = (
    r"\bo texto (?:deixa claro|[ée] expresso|afirma|informa|traz|menciona|apresenta|esclarece|destaca)\b"
    r"|\bconforme o texto\b|\bclassifica[cç][aã]o apresentada\b"
    r"|\bno material\b|\bconforme o material\b|\bo material (?:traz|afirma|apresenta|informa|destaca|menciona)\b"
)
SUPPORT_TEXT_SUBJECTS = ("portugues", "ingles", "redacao", "lingua")
# Stems that can't be answered without an image.
IMAGE_PHRASES = (
    r"\b(imagem|figura|tira|quadrinho|gr[aá]fico|ilustra[cç][aã]o|foto(?:grafia)?|mapa)\s+a\s+seguir\b"
    r"|\bleitura\s+da\s+tira\b|\bcom\s+base\s+n[ao]\s+(imagem|figura|tira|gr[aá]fico)\b|\bobserve\s+a\s+(imagem|figura|tira|gr[aá]fico)\b"
)
# A reference to an option's letter; a question number split by a space.
LETTER_REFERENCE = r"((?:[Aa]lternativa|[Ll]etra|[Oo]p[cç][aã]o|[Ii]tem)\s+)([A-Ea-e])\b"
BROKEN_NUMBER = r"(QUEST[AÃ]O\s*\d+) (\d+)(?=\s*[:.\-–])"


def squeeze(s: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def fold(s: Column) -> Column:
    """Accents and other non-ASCII removed, lower case, other runs than a-z 0-9 one space."""
    ascii_only = F.regexp_replace(F.translate(s, _ACCENTED + "ºª", _PLAIN + "oa"), r"[^\x00-\x7f]", "")
    return F.trim(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", " "))


def fold_text(s: str) -> str:
    """As ``fold``, for one string."""
    plain = s.translate(str.maketrans(_ACCENTED + "ºª", _PLAIN + "oa"))
    return re.sub("[^a-z0-9]+", " ", re.sub(r"[^\x00-\x7f]", "", plain).lower()).strip(" ")


def _fold_series(s: pd.Series) -> pd.Series:
    plain = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())
    return plain.str.replace("[^a-z0-9]+", " ", regex=True).str.strip()


def fold_any(s: Column) -> Column:
    """As ``fold``, with the whole compatibility table of Unicode (slower: runs in Python)."""
    return F.pandas_udf(_fold_series, "string")(s)


def tokens(folded: Column) -> Column:
    """Words of a folded name, Roman numerals i to x as digits."""
    known = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return F.transform(F.filter(F.split(folded, " "), lambda t: t != ""), lambda t: F.coalesce(F.element_at(known, t), t))


def same_token(a: Column, b: Column) -> Column:
    """Equal, or neither is a number and one of two letters or more begins the other."""
    number = a.rlike("^[0-9]+$") | b.rlike("^[0-9]+$")
    begins = F.when(F.length(a) <= F.length(b), (F.length(a) >= 2) & F.startswith(b, a)).otherwise((F.length(b) >= 2) & F.startswith(a, b))
    return (a == b) | (~number & begins)


def names_match(a: Column, b: Column) -> Column:
    """Whether the shorter token list is a run of the longer; never for an empty one."""
    x, y = tokens(a), tokens(b)

    def within(short: Column, long: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(long) - F.size(short))
        places = F.sequence(F.lit(0), F.size(short) - 1)
        return F.exists(starts, lambda i: F.forall(places, lambda k: same_token(F.get(short, k), F.get(long, i + k))))

    return F.when((F.size(x) == 0) | (F.size(y) == 0), False).when(F.size(x) <= F.size(y), within(x, y)).otherwise(within(y, x))


def quotations(s: Column) -> Column:
    """Texts between straight or typographic, double or single quotation marks."""
    return F.transform(F.regexp_extract_all(s, F.lit(QUOTED), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))


def quotation_key(s: Column) -> Column:
    """What literal comparison looks at: no white space, formula marks or ordinal signs; one dash; upper case."""
    s = F.regexp_replace(s, "[−–—]", "-")
    s = F.regexp_replace(s, r"[°ºª$]|\\[\[\]()]", "")
    return F.upper(F.regexp_replace(s, r"(?U)\s+", ""))


def upper_by_letter(s: Column) -> Column:
    """Upper case that keeps each letter one letter; Latin-1 but ß goes the quicker way."""
    return F.when(s.rlike(r"[^\x{00}-\x{de}\x{e0}-\x{ff}]"), F.translate(s, _LOWER, _UPPER)).otherwise(F.upper(s))


def quotation_pieces(s: Column) -> Column:
    return F.flatten(F.transform(quotations(s), lambda q: F.split(q, JOINS)))


def quotations_hold(s: Column, passage: Column, required: Column) -> Column:
    """Whether each piece of each quotation is literally in the passage; without any, whether none is required."""
    key = quotation_key(passage)
    held = F.forall(quotation_pieces(s), lambda p: (quotation_key(p) == "") | F.contains(key, quotation_key(p)))
    return F.when(F.size(quotations(s)) == 0, ~required).otherwise(held)


def _first(s: Column, phrases: str) -> Column:
    return F.nullif(F.regexp_extract(s, f"(?iU)(?:{phrases})", 0), F.lit(""))


def source_reference(stem: Column, comment: Column, answer: Column, options: Column, form: Column, subject: Column) -> Column:
    """First phrase that names an unseen source, or the empty string."""
    whole = F.array_join(F.filter(F.concat(F.array(stem, comment, answer), F.coalesce(F.map_values(options), F.array().cast("array<string>"))), lambda p: p.isNotNull() & (p != "")), " ")
    plain = fold(subject)
    own_text = F.lit(False)
    for name in SUPPORT_TEXT_SUBJECTS:
        own_text = own_text | F.startswith(plain, F.lit(name))
    named = F.coalesce(subject, F.lit("")) != ""
    return F.coalesce(_first(whole, SOURCE_PHRASES), F.when(form == "certo_errado", _first(whole, OPTION_PHRASES)), F.when(named & ~own_text, _first(whole, TEXT_PHRASES)), F.lit(""))


def needs_image(stem: Column) -> Column:
    return F.coalesce(stem, F.lit("")).rlike(f"(?iU)(?:{IMAGE_PHRASES})")


def answer_key(form: Column, raw: Column, options: Column, *, whole_first: bool = True) -> Column:
    """CERTO, ERRADO, an option's letter, or null. ``whole_first`` tries the whole answer as a letter."""
    g = F.regexp_replace(F.upper(strip(raw)), r"\.+$", "")
    letters = F.coalesce(F.map_keys(options), F.array().cast("array<string>"))
    first = F.substring(g, 1, 1)
    choice = F.when(F.array_contains(letters, first), first)
    if whole_first:
        choice = F.when(F.array_contains(letters, g), g).otherwise(choice)
    return F.when(form == "certo_errado", F.when(F.startswith(g, F.lit("C")), "CERTO").when(F.startswith(g, F.lit("E")), "ERRADO")).when(form == "abcde", choice)


def option_map(block: Column, *, bracketed: bool = False) -> Column:
    """Options from at least three line-start markers ``X)``; the last of a repeated letter wins; else null."""
    mark = r"\(?[A-E]\)" if bracketed else r"[A-E]\)"
    parts = F.filter(F.split(block, rf"(?md)(?=^{mark})"), lambda p: p.rlike(rf"^{mark}"))
    entries = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "([A-E])", 1).alias("key"), squeeze(F.regexp_replace(p, rf"(?U)^{mark}\s*", "")).alias("value")))
    letters = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(letters, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.when(F.size(parts) >= 3, F.map_from_entries(last))


def stem_and_form(block: Column, *, bracketed: bool = False) -> Column:
    """Struct of the stem before the options or the true/false boxes, and the form (null if neither)."""
    mark = r"\(?[A-E]\)" if bracketed else r"[A-E]\)"
    box = r"(?iU)\(\s*\)\s*Certo"
    form = F.when(option_map(block, bracketed=bracketed).isNotNull(), "abcde").when(block.rlike(box), "certo_errado")
    stem = F.when(form == "abcde", F.get(F.split(block, rf"(?md)^{mark}", 2), F.lit(0))).when(form == "certo_errado", F.get(F.split(block, box, 2), F.lit(0))).otherwise(block)
    return F.struct(squeeze(stem).alias("stem"), form.alias("form"))


def join_broken_numbers(s: Column) -> Column:
    return F.regexp_replace(s, f"(?iU){BROKEN_NUMBER}", "$1$2")


def without_suffix(name: Column) -> Column:
    """A file's name without directories and the last suffix."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def name_parts(name: Column) -> Column:
    """Struct exam, subject of ``NN - EXAM - MQ DIGITAL - Subject``; nulls for other names."""
    form = r"(?iU)^(?:\d+\s*-\s*)?([A-ZÀ-Ú]+)\s*-\s*MQE?\s*DIGITAL\s*-\s*(.+)$"
    base = without_suffix(name)
    good = base.rlike(form)
    return F.struct(F.when(good, F.upper(squeeze(F.regexp_extract(base, form, 1)))).alias("exam"), F.when(good, squeeze(F.regexp_extract(base, form, 2))).alias("subject"))


def subject_after_mark(name: Column) -> Column:
    """What follows MQ, MQE or MEQ DIGITAL in a file's name, or null."""
    return F.nullif(strip(F.regexp_replace(F.regexp_extract(without_suffix(name), r"(?iU)(?:MQE?|MEQ)\s*DIGITAL(.*)$", 1), "^[ -]+", "")), F.lit(""))


def subject_of_book(name: Column, exam: Column) -> Column:
    """What follows ``Esquematizada -``; else the name without number and exam."""
    base = without_suffix(name)
    tag = r"(?iU)Esquematizada\s*-\s*"
    bare = F.regexp_replace(base, r"(?U)^\d+\s*-\s*", "")
    head = F.concat(F.lit(r"(?iU)^\Q"), exam, F.lit(r"\E\s*-\s*"))
    return F.nullif(strip(F.when(base.rlike(tag), F.get(F.split(base, tag, 2), F.lit(1))).otherwise(F.regexp_replace(bare, head, ""))), F.lit(""))


def remap_letters(s: Column, new_letters: Column) -> Column:
    """Letter references rewritten all at once by a map of old to new upper-case letters."""
    private = "\ue000\ue001\ue002\ue003\ue004"
    out = s
    for letter, mark in zip("ABCDE", private, strict=True):
        own = LETTER_REFERENCE.replace("[A-Ea-e]", f"[{letter}{letter.lower()}]")
        out = F.when(F.element_at(new_letters, F.lit(letter)).isNull(), out).otherwise(F.regexp_replace(out, f"(?U){own}", f"$1{mark}"))
    return _unmask(out, new_letters, private)


def _unmask(s: Column, new_letters: Column, private: str) -> Column:
    for letter, mark in zip("ABCDE", private, strict=True):
        s = F.replace(s, F.lit(mark), F.coalesce(F.element_at(new_letters, F.lit(letter)), F.lit(letter)))
    return s


def shuffle_options(options: Column, key: Column, seed: Column, texts: Mapping[str, Column]) -> Column:
    """Struct of reordered options, the moved key and ``texts`` with letters rewritten.

    The order is a hash of the seed and the letter. Options beyond five are dropped;
    nothing changes if the key isn't an option.
    """
    entries = F.array_sort(F.transform(F.map_entries(options), lambda e: F.struct(F.xxhash64(seed, e["key"]).alias("h"), e["key"].alias("old"), e["value"].alias("text"))))
    dealt = F.transform(F.slice(entries, 1, 5), lambda e, i: F.struct(F.substring(F.lit("ABCDE"), i + 1, F.lit(1)).alias("new"), e["old"].alias("old"), e["text"].alias("text")))
    fits = F.coalesce(F.map_contains_key(options, key), F.lit(False))
    moved = F.map_from_entries(F.transform(dealt, lambda d: F.struct(d["old"], d["new"])))
    fresh = F.map_from_entries(F.transform(dealt, lambda d: F.struct(d["new"], d["text"])))
    return F.struct(
        F.when(fits, fresh).otherwise(options).alias("options"),
        F.when(fits, F.element_at(moved, key)).otherwise(key).alias("key"),
        *[F.when(fits & text.isNotNull(), remap_letters(text, moved)).otherwise(text).alias(name) for name, text in texts.items()],
    )


def options_block(options: Column) -> Column:
    """``A) text`` lines in letter order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def fill_template(template: str, values: Mapping[str, Column], optional: Mapping[str, str] | None = None) -> Column:
    """``template`` with {name} replaced; an ``optional`` block is empty when its value is."""
    out = F.lit(template)
    for name, block in (optional or {}).items():
        text = F.replace(F.lit(block), F.lit("{" + name + "}"), values[name])
        out = F.replace(out, F.lit("{" + name + "_block}"), F.coalesce(F.when(filled(values[name]), text), F.lit("")))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def shortened(s: Column, size: int = 200) -> Column:
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size), F.lit("..."))).otherwise(s)


def content_hash(s: Column) -> Column:
    return F.sha2(s, 256)
