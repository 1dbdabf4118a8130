"""Unicode-based normalisers, and the English one. The regex stages are Catalyst; Unicode forms and numbers are pandas UDFs."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import english_numbers
from tidemark.functions.text import col

#: Letters that no Unicode form takes apart.
EXTRA = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
_MARKS = regex.compile(r"\p{Mn}")
_SYMBOLS = regex.compile(r"[\p{M}\p{S}\p{P}]")

#: Fillers, and the rewriting rules in their order.
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"
WORDS = {
    "won't": "will not", "can't": "can not", "let's": "let us", "ain't": "aint", "y'all": "you all", "wanna": "want to", "gotta": "got to", "gonna": "going to",
    "i'ma": "i am going to", "imma": "i am going to", "woulda": "would have", "coulda": "could have", "shoulda": "should have", "ma'am": "madam",
}
TITLES = {
    "mr": "mister", "mrs": "missus", "st": "saint", "dr": "doctor", "prof": "professor", "capt": "captain", "gov": "governor", "ald": "alderman", "gen": "general", "sen": "senator",
    "rep": "representative", "pres": "president", "rev": "reverend", "hon": "honorable", "asst": "assistant", "assoc": "associate", "lt": "lieutenant", "col": "colonel", "jr": "junior", "sr": "senior", "esq": "esquire",
}
ENDINGS = {
    "'d been": "had been", "'s been": "has been", "'d gone": "had gone", "'s gone": "has gone", "'d done": "had done", "'s got": "has got",
    "n't": "not", "'re": "are", "'s": "is", "'d": "would", "'ll": "will", "'t": "not", "'ve": "have", "'m": "am",
}
KEPT_SYMBOLS = ".%$¢€£"
# British spellings, by rule: stems and the endings that they take. A map of whole words may be given beside them.
OUR = "arb ard arm behavi cand cl clam col demean endeav enam fav ferv flav glam harb hon hum lab neighb od parl ranc rig rum sav savi splend succ tum vap val vig".split()
OUR_ENDINGS = "|s|ed|ing|er|ers|able|ably|ite|ites|less|ful|fully|hood|hoods|ly|y|ize|ized|izes|izing".split("|")
RE = "cent met fib lit lust meag mit sab somb spect theat kilomet centimet millimet manoeuv sepulch och calib".split()
DOUBLED = "cancel channel counsel dial duel equal fuel fulfil enrol grovel jewel label level libel marvel model panel pedal pencil quarrel refuel reveal rival shovel signal snivel spiral total towel travel tunnel unravel wool".split()
DOUBLED_ENDINGS = "ed|ing|er|ers|ings|ous|ously".split("|")
ISE = (
    "agon amort anonym antagon apolog atom author bapt brutal cannibal canon capital categor cauter central character civil colon computer critic crystall custom decentral demobil democrat demor demoral digit dramat econom emphas energ eulog extempor "
    "external familiar fantas fertil final formal fossil fratern galvan general global glamor harmon hospital human hybrid hypnot ideal idol immobil immortal immun individual industrial initial internal ion ital item jeopard legal legitim liberal lion local "
    "magnet marginal material maxim mechan memor mesmer metabol minim mobil modern monopol moral motor national natural neutral normal notar optim organ ostrac oxid patron pasteur penal personal philosoph plagiar polar polit popular priorit privat professional public "
    "pulver rational real recogn reorgan revital revolution romantic satir scandal scrutin secular sensit serial social solemn special stabil standard steril stigmat subsid summar symbol sympath synchron synthes system tantal terror theor tranquil trivial tyrann union urban "
    "util vandal vapor verbal victim visual vital vocal vulgar weapon western"
).split()
ISE_ENDINGS = "e|ed|es|er|ers|ing|ation|ations|able".split("|")
YSE = "anal paral catal electrol hydrol".split()
OTHER = {
    "grey": "gray", "greys": "grays", "greyish": "grayish", "tyre": "tire", "tyres": "tires", "kerb": "curb", "plough": "plow", "ploughs": "plows", "programme": "program", "programmes": "programs", "cheque": "check",
    "cheques": "checks", "defence": "defense", "defences": "defenses", "offence": "offense", "offences": "offenses", "licence": "license", "licences": "licenses", "pretence": "pretense", "sceptic": "skeptic", "sceptical": "skeptical",
    "catalogue": "catalog", "catalogues": "catalogs", "dialogue": "dialog", "dialogues": "dialogs", "analogue": "analog", "aluminium": "aluminum", "moustache": "mustache", "pyjamas": "pajamas", "storey": "story", "aeroplane": "airplane",
    "anaemia": "anemia", "anaesthetic": "anesthetic", "paediatric": "pediatric", "encyclopaedia": "encyclopedia", "foetus": "fetus", "oestrogen": "estrogen", "diarrhoea": "diarrhea", "leukaemia": "leukemia", "jewellery": "jewelry",
    "skilful": "skillful", "wilful": "willful", "instalment": "installment", "enrolment": "enrollment", "fulfilment": "fulfillment", "mould": "mold", "moulds": "molds", "smoulder": "smolder", "draught": "draft", "woollen": "woolen",
}


def spelling_map() -> dict[str, str]:
    """Whole words and their other spelling, as stems and their endings make them. No other word is respelled."""
    out = {f"{s}our{e}": f"{s}or{e}" for s in OUR for e in OUR_ENDINGS}
    out |= {f"{s}re{e}": f"{s}er{e}" for s in RE for e in ("", "s")} | {f"{s}red": f"{s}ered" for s in RE}
    out |= {f"{s}l{e}": s + e for s in DOUBLED for e in DOUBLED_ENDINGS if s not in ("fulfil", "enrol", "reveal")}
    out |= {f"{s}is{e}": f"{s}iz{e}" for s in ISE for e in ISE_ENDINGS} | {f"{s}ys{e}": f"{s}yz{e}" for s in YSE for e in ("e", "ed", "er", "ers", "ing")}
    return out | OTHER


SPELLINGS = spelling_map()


def without_symbols(text: str, diacritics: bool = True, keep: str = "") -> str:
    """Marks, symbols and punctuation as spaces; with diacritics=False, marks dropped and letters taken to their base."""
    if diacritics:
        return _SYMBOLS.sub(" ", unicodedata.normalize("NFKC", text))
    out = []
    for c in unicodedata.normalize("NFKD", text):
        if c in keep or c in EXTRA:
            out.append(c if c in keep else EXTRA[c])
        elif not _MARKS.match(c):
            out.append(_SYMBOLS.sub(" ", c))
    return "".join(out)


def _column(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def mapped(t: pd.Series) -> pd.Series:
        return t.map(f, na_action="ignore")

    return mapped


def remove_symbols(text: Column | str, diacritics: bool = True, keep: str = "") -> Column:
    return _column(lambda x: without_symbols(x, diacritics, keep))(col(text))


def basic(text: Column | str, remove_diacritics: bool = False, split_letters: bool = False) -> Column:
    """Lower case, without brackets and symbols, white space collapsed but not trimmed; split_letters parts all graphemes."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")
    plain = F.lower(remove_symbols(bare, not remove_diacritics))
    if split_letters:
        plain = _column(lambda x: " ".join(regex.findall(r"\X", x)))(plain)
    return F.regexp_replace(plain, r"(?U)\s+", " ")


def spellings_of(spark: SparkSession, path: str, limit: int = 1_000_000) -> dict[str, str]:
    """Spellings from a JSON object of words, or from lines of a word, white space and its spelling. A table of more than limit words is an error: it goes to
    each worker."""
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "spelling"))
    else:
        parts = F.split(F.trim("value"), r"\s+")
        rows = spark.read.text(path).where(F.size(parts) > 1).select(parts[0].alias("word"), parts[1].alias("spelling"))
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a table of more than {limit} words")
    return {r["word"]: r["spelling"] for r in found}


def _respelled(text: str, spellings: dict[str, str]) -> str:
    return " ".join(spellings.get(w, w) for w in text.split())


def respelled(text: Column | str, spellings: dict[str, str] = SPELLINGS) -> Column:
    """Each word by the map, joined by one space. A map in Spark is searched from its beginning for each word, so this is a dictionary in Python."""
    return _column(lambda x: _respelled(x, spellings))(col(text))


def english(text: Column | str, spellings: dict[str, str] = SPELLINGS) -> Column:
    """Brackets, fillers, contractions, titles, numbers, spellings and symbols, in this order."""
    def sub(t: Column, rule: tuple[str, str]) -> Column:
        return F.regexp_replace(t, rule[0], rule[1])

    rules = [(r"[<\[][^>\]]*[>\]]", ""), (r"\(([^)]+?)\)", ""), (FILLERS, ""), (r"(?U)\s+'", "'")]
    rules += [(rf"(?U)\b{k}\b", v) for k, v in WORDS.items()] + [(rf"(?U)\b{k}\b", v + " ") for k, v in TITLES.items()] + [(rf"(?U){k}\b", " " + v) for k, v in ENDINGS.items()]
    rules += [(r"(\d),(\d)", "$1$2"), (r"\.([^0-9]|$)", " $1")]
    bare = reduce(sub, rules, F.lower(col(text)))
    spelled = _column(lambda x: _respelled(english_numbers(without_symbols(x, False, KEPT_SYMBOLS)), spellings))(bare)
    done = [(r"[.\$¢€£]([^0-9])", " $1"), (r"([^0-9])%", "$1 "), (r"(?U)\s+", " ")]
    return reduce(sub, done, spelled)
