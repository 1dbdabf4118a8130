"""Token sequences: filters, prompts, words from tokens, Unicode-safe cuts."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col

REPLACEMENT = "�"
#: Languages that put no spaces between words.
UNSPACED = ("zh", "ja", "th", "lo", "my", "yue")
#: Language codes and names.
LANGUAGES = dict(
    pair.split("=") for pair in """en=english zh=chinese de=german es=spanish ru=russian ko=korean fr=french ja=japanese pt=portuguese tr=turkish pl=polish ca=catalan nl=dutch ar=arabic sv=swedish
    it=italian id=indonesian hi=hindi fi=finnish vi=vietnamese he=hebrew uk=ukrainian el=greek ms=malay cs=czech ro=romanian da=danish hu=hungarian ta=tamil no=norwegian th=thai ur=urdu hr=croatian
    bg=bulgarian lt=lithuanian la=latin mi=maori ml=malayalam cy=welsh sk=slovak te=telugu fa=persian lv=latvian bn=bengali sr=serbian az=azerbaijani sl=slovenian kn=kannada et=estonian mk=macedonian
    br=breton eu=basque is=icelandic hy=armenian ne=nepali mn=mongolian bs=bosnian kk=kazakh sq=albanian sw=swahili gl=galician mr=marathi pa=punjabi si=sinhala km=khmer sn=shona yo=yoruba so=somali
    af=afrikaans oc=occitan ka=georgian be=belarusian tg=tajik sd=sindhi gu=gujarati am=amharic yi=yiddish lo=lao uz=uzbek fo=faroese ht=haitian ps=pashto tk=turkmen nn=nynorsk mt=maltese
    sa=sanskrit lb=luxembourgish my=myanmar bo=tibetan tl=tagalog mg=malagasy as=assamese tt=tatar haw=hawaiian ln=lingala ha=hausa ba=bashkir jw=javanese su=sundanese yue=cantonese""".split()
)
LANGUAGES["ht"] = "haitian creole"
#: Other names.
ALIASES = {
    "burmese": "my", "valencian": "ca", "flemish": "nl", "haitian": "ht", "letzeburgesch": "lb", "pushto": "ps", "panjabi": "pa", "moldavian": "ro", "moldovan": "ro", "sinhalese": "si", "castilian": "es", "mandarin": "zh",
}


#: The pattern by which byte-level vocabularies part a text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def language_code(name: Column | str) -> Column:
    """Code by code, name or alias; an error for anything else."""
    n = F.lower(col(name))
    table = {**{k: k for k in LANGUAGES}, **{v: k for k, v in LANGUAGES.items()}, **ALIASES}
    code = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[n]
    return F.when(n.isNull() | code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("unknown language "), n)).cast("string"))


def text_ids(ids: Column | str, end_of_text: int) -> Column:
    return F.filter(col(ids), lambda x: x < end_of_text)


def without_timestamps(ids: Column | str, begin: int) -> Column:
    return F.filter(col(ids), lambda x: x < begin)


def with_prompt(context: Column | str, forced: list[int], ids: Column | str, previous: int, context_size: int) -> Column:
    """The last half of the context behind its mark, the forced prefix, then the ids."""
    kept = F.slice(col(context), -F.least(F.size(col(context)), F.lit(context_size // 2 - 1)), F.lit(context_size // 2 - 1))
    head = F.when(F.size(col(context)) > 0, F.concat(F.array(F.lit(previous)), kept)).otherwise(F.array().cast("array<int>"))
    return F.concat(head, F.array(*map(F.lit, forced)), col(ids))


def beams(ids: Column | str, n: int) -> Column:
    return F.array_repeat(col(ids), n)


def split_on_unicode(parts: Column | str) -> Column:
    """Groups of byte strings, each up to where the bytes so far are valid UTF-8; what is left open at the end is a last group."""
    empty = F.struct(F.array().cast("array<array<binary>>").alias("done"), F.array().cast("array<binary>").alias("open"))

    def step(state: Column, part: Column) -> Column:
        now = F.concat(state["open"], F.array(part))
        whole = F.aggregate(now, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
        valid = F.is_valid_utf8(whole.cast("string"))
        return F.struct(F.when(valid, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), F.when(valid, F.array().cast("array<binary>")).otherwise(now).alias("open"))

    return F.aggregate(col(parts), empty, step, lambda state: F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]))


def words_from_pieces(pieces: Column | str, special: Column | None = None, language: Column | None = None) -> Column:
    """Pieces put together to words: a new one begins at a special piece, a leading space or punctuation alone. special: booleans. In the languages
    that put no spaces between words each piece is a word."""
    pieces = col(pieces)
    marks = F.array(*map(F.lit, string.punctuation))
    flags = special if special is not None else F.transform(pieces, lambda x: F.lit(False))
    pairs = F.zip_with(pieces, flags, lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    empty = F.array().cast("array<string>")

    def step(words: Column, x: Column) -> Column:
        fresh = x["s"] | x["p"].startswith(" ") | F.array_contains(marks, F.trim(x["p"])) | (F.size(words) == 0)
        n = F.size(words)
        longer = F.concat(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")), x["p"])))
        return F.when(fresh, F.concat(words, F.array(x["p"]))).otherwise(longer)

    words = F.aggregate(pairs, empty, step)
    return words if language is None else F.when(language.isin(*UNSPACED), pieces).otherwise(words)


def pre_tokens(text: Column | str) -> Column:
    """A stand-in for a vocabulary: contractions, words, numbers and symbol runs, each with its leading space."""
    return F.regexp_extract_all(col(text), F.lit(PRE_TOKEN), 0)
