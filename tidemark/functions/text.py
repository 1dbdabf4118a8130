"""Text functions over columns: normalisation, tokenising, paths, prompts. All of them stay in Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CJK blocks that call for character-level treatment.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}]"
#: Substrings that hint at Cantonese and at Mandarin, in this order.
YUE_HINTS = ("yue", "canton", "hongkong", "hk")
ZH_HINTS = ("zh", "cmn", "mandarin", "chi", "cn")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Variants written as one.
VARIANTS = ("两兩俩萬億", "二二二万亿")
#: Unicode's white space.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
VOWELS = "aeiouyAEIOUY"
TEXT_PROMPT = "Given the following ASR transcription candidates, predict the correct continuation."
AUDIO_PROMPT = "Given the audio and the following ASR transcription candidates, predict the correct continuation."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it; a plain expression inside a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_cjk(text: Column | str) -> Column:
    text = col(text)
    return text.rlike(r"[\x{3400}-\x{10FFFF}]") & text.rlike(CJK)  # most texts have nothing in the one range, which is told faster


def strip(text: Column | str) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.trim(col(text), F.lit(WHITE_SPACE))


def collapse(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), r"(?U)\s+", " "))


def ascii_lower(text: Column | str) -> Column:
    return F.translate(col(text), UPPER, LOWER)


def ascii_upper(text: Column | str) -> Column:
    return F.translate(col(text), LOWER, UPPER)


def unify_variants(text: Column | str) -> Column:
    return F.translate(col(text), *VARIANTS)


def drop_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\p{P}", "")


def drop_ascii_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\p{Punct}", "")


def punctuation_to_space(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[\p{Punct}\p{P}]", " ")


def normalisation_language(language: Column | str, text: Column | str) -> Column:
    """'yue', 'zh' or null: by an exact name, by hints in the name, or by CJK characters in the text."""
    lang, text = F.lower(strip(F.coalesce(col(language), F.lit("")))), col(text)
    hinted = lambda hints: lang.rlike("|".join(hints))
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(lang.isin("yue", "zh"), lang)
        .when(hinted(YUE_HINTS), F.lit("yue"))
        .when(hinted(ZH_HINTS), F.lit("zh"))
        .when(has_cjk(text), F.lit("zh"))
    )


def for_mixed_rate(text: Column | str, language: Column | str, han=None) -> Column:
    """The text as the mixed error rate sees it. han: a function of (text, language) for numbers and scripts, if wanted."""
    def normal(x: Column) -> Column:
        lang = x["lang"]
        converted = han(x["bare"], lang) if han else x["bare"]
        return F.when(lang.isNotNull(), ascii_lower(unify_variants(converted))).otherwise(F.lower(x["bare"]))

    def ready(bare: Column) -> Column:
        return F.struct(bare.alias("bare"), normalisation_language(language, bare).alias("lang"))

    if han:  # may run in Python, where values can't be bound
        return collapse(punctuation_to_space(normal({"bare": strip(text), "lang": normalisation_language(language, strip(text))})))
    return collapse(punctuation_to_space(bound(bound(strip(text), ready), normal)))


def mixed_tokens(text: Column | str, language: Column | str) -> Column:
    """Under zh or yue each ASCII run and each other visible character is a token; otherwise words by white space."""
    text = col(text)
    bare = strip(text)
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"(?U)\s+"))
    return F.when(col(language).isin("zh", "yue"), F.regexp_extract_all(text, F.lit(r"[\x21-\x7E]+|[^\s\x00-\x7F]"), 0)).otherwise(words)


def for_character_rate(reference: Column | str, hypothesis: Column | str, language: Column | str, han=None) -> tuple[Column, Column]:
    """Both sides as the character error rate sees them; the language comes from both texts together."""
    reference, hypothesis = strip(reference), strip(hypothesis)
    lang = (bound if not han else lambda x, f: f(x))(F.concat(reference, hypothesis), lambda both: normalisation_language(language, both))

    def one(text: Column) -> Column:
        def normal(x: Column) -> Column:
            converted = ascii_lower(unify_variants(han(x["text"], x["lang"]) if han else x["text"]))
            cjk = drop_punctuation(F.regexp_replace(converted, r"[\p{Punct} ]", ""))
            return F.when(x["lang"].isNotNull(), cjk).otherwise(drop_ascii_punctuation(F.lower(x["text"])))

        return normal({"text": text, "lang": lang}) if han else bound(F.struct(text.alias("text"), lang.alias("lang")), normal)

    return one(reference), one(hypothesis)


def for_training(text: Column | str) -> Column:
    """Without punctuation, ASCII upper-cased, with a space where Latin and Han letters meet."""
    bare = ascii_upper(F.regexp_replace(col(text), r"[\p{Punct}\p{P}]", ""))
    spaced = F.regexp_replace(bare, r"([A-Za-z])([\x{4E00}-\x{9FFF}])", "$1 $2")
    return F.regexp_replace(spaced, r"([\x{4E00}-\x{9FFF}])([A-Za-z])", "$1 $2")


def syllables(text: Column | str) -> Column:
    """Latin words cut into consonants with vowels (and one consonant more before another), all else by character or space run."""
    parts = F.regexp_extract_all(col(text), F.lit(r"[A-Za-z]+|[\x{4E00}-\x{9FFF}]|\s+|\S"), 0)
    v, c = f"[{VOWELS}]", f"[^{VOWELS}]"
    inner = lambda w: F.regexp_extract_all(w, F.lit(rf"{c}*{v}+(?:{c}(?={c}))?|{c}+"), 0)
    return F.flatten(F.transform(parts, lambda w: F.when(w.rlike("^[A-Za-z]+$"), inner(w)).otherwise(F.array(w))))


def common_prefix_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix of two strings."""
    a, b = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    n = F.least(F.length(a), F.length(b))
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k))
    return F.when(n == 0, F.lit(0)).otherwise(walked)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    return F.substr(F.coalesce(col(a), F.lit("")), F.lit(1), common_prefix_length(a, b))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """The base name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=[^.])(\.[^.]*)$", 1))


def first_integer(path: Column | str) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(stem(path), r"(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int")


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *map(col, parts))


def strip_replacement_marks(text: Column | str) -> Column:
    """Without U+FFFD at the end: what is left of a character that was cut."""
    return F.regexp_replace(col(text), "�+$", "")


def drop_blank(candidates: Column | str) -> Column:
    return F.filter(col(candidates), lambda x: x.isNotNull() & (strip(x) != ""))


def first_not_blank(candidates: Column | str) -> Column:
    return F.coalesce(F.try_element_at(drop_blank(candidates), F.lit(1)), F.lit(""))


def noise_variant(path: Column | str, key: Column | str, levels: tuple[str, ...] = ("0", "5", "10", "20")) -> Column:
    """The path with its noise level replaced by one chosen by a hash of key, so that runs agree."""
    level = F.element_at(F.array(*map(F.lit, levels)), (F.pmod(F.xxhash64(col(key)), F.lit(len(levels))) + 1).cast("int"))
    return F.regexp_replace(col(path), F.lit(r"snr[-]?\d+"), F.concat(F.lit("snr"), level))


def prompt(candidates: Column | str, previous: Column | str, count: Column | int | None = None, audio: bool = False) -> Column:
    """The instruction for a corrector: numbered candidates and the confirmed text."""
    candidates, previous = col(candidates), F.coalesce(col(previous), F.lit(""))
    if count is not None:
        candidates = F.slice(candidates, F.lit(1), count if isinstance(count, Column) else F.lit(count))
    listed = F.array_join(F.transform(candidates, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n")
    basis = "Based on the audio" if audio else "Based on the context and candidates"
    return F.concat(
        F.lit(f'{AUDIO_PROMPT if audio else TEXT_PROMPT}\n\nPrevious confirmed transcript: "'), previous,
        F.lit('"\n\nK-best candidates for the continuation:\n'), listed,
        F.lit(f'\n\n{basis}, what is the correct text that should be appended after "'), previous, F.lit('"?'),
    )


def conversation(instruction: Column | str, response: Column | str | None = None, system: str = "You are a helpful assistant.") -> Column:
    """Chat messages; the assistant's is there only with a response."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    start = F.array(turn("system", F.lit(system)), turn("user", col(instruction)))
    if response is None:
        return start
    return F.when(col(response).isNull(), start).otherwise(F.concat(start, F.array(turn("assistant", col(response)))))


def timestamp_text(seconds: Column | str, hours: bool = False, mark: str = ".") -> Column:
    """H:MM:SS with milliseconds, half to even; hours only where needed or asked for. Null for a negative time."""
    ms = F.bround(col(seconds).cast("decimal(24,9)") * 1000, 0).cast("long")
    h, m, s, r = (ms / 3_600_000).cast("long"), (ms / 60_000).cast("long") % 60, (ms / 1000).cast("long") % 60, ms % 1000
    lead = F.format_string("%02d:", h) if hours else F.when(h > 0, F.format_string("%02d:", h)).otherwise(F.lit(""))
    return F.when(ms >= 0, F.concat(lead, F.format_string(f"%02d:%02d{mark}%03d", m, s, r)))


def cue_text(text: Column | str) -> Column:
    """A subtitle's text: trimmed, and without the arrow that parts times."""
    return F.replace(strip(text), F.lit("-->"), F.lit("->"))


def underlined(text: Column | str, word: Column | str) -> Column:
    """The first occurrence of word underlined."""
    text, word = col(text), col(word)
    at = F.call_function("locate", word, text)
    return F.when((at == 0) | (word == ""), text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), F.lit("<u>"), word, F.lit("</u>"), F.substr(text, at + F.length(word))))


def emission_line(now: Column | str, start: Column | str, end: Column | str, text: Column | str) -> Column:
    """`now start end text`, times in milliseconds."""
    return F.format_string("%.4f %.0f %.0f %s", col(now) * 1000, col(start) * 1000, col(end) * 1000, col(text))


def parse_bool(text: Column | str) -> Column:
    return F.when(col(text) == "True", True).when(col(text) == "False", False)


def exact_div(x: Column | str, y: Column | str) -> Column:
    """x / y, which must leave no rest."""
    x, y = col(x), col(y)
    return F.when(x % y == 0, (x / y).cast("long")).otherwise(F.raise_error(F.lit("not a whole quotient")).cast("long"))


def strip_brackets(text: Column | str) -> Column:
    """Lower-cased, without what <>, [] and () hold, symbols as spaces, spaces collapsed: the built-in part of the basic normaliser."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\p{M}\p{S}\p{P}]", " "), r"(?U)\s+", " ")
