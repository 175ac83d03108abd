"""Text kernels: canonical, model, topic and twin text, tokens, folding, lexicon scoring.

Everything that Spark's functions can say stays in the JVM; Unicode decomposition and character names, which they cannot,
are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values -------------------------------------------------------------------------------------------------
LETTERS = r"[\p{L}\p{No}\p{Nl}]"
WORD = LETTERS + "+(?:-" + LETTERS + "+)*"
URL = r"(?i)(?:https?://|www\.)\S+"
MENTION = r"@[\w.\-]+"
TIMESTAMP = r"\b\d{1,2}(?::\d{2}){1,2}\b"
LAUGHTER = r"(?i)^(?:k{2,}|(?:ha){2,}|(?:rs){2,}|h[aeiu]{2,}|s{2,})$"
MIN_TOKEN = 3
SEQUENCES = {
    "\U0001f1e7\U0001f1f7": "bandeira do Brasil",
    "\U0001f1f5\U0001f1f9": "bandeira de Portugal",
    "\U0001f1fa\U0001f1f8": "bandeira dos Estados Unidos",
}
EMOJI = {
    "😂": "risos",
    "🤣": "risos",
    "😅": "risos",
    "😆": "risos",
    "😀": "risos",
    "😃": "risos",
    "😄": "risos",
    "❤": "coração",
    "💙": "coração",
    "💓": "coração",
    "💕": "coração",
    "😍": "amei",
    "🥰": "amei",
    "😊": "sorriso",
    "🤩": "maravilhoso",
    "👏": "aplausos",
    "👍": "positivo",
    "🙏": "por favor",
    "🎉": "comemoração",
    "🔥": "fogo",
    "✅": "certo",
    "😎": "estiloso",
    "👎": "negativo",
    "😢": "choro",
    "😭": "choro",
    "🥹": "choro",
    "😠": "raiva",
    "😡": "raiva",
    "🤦": "decepção",
    "💩": "lixo",
    "☠": "morte",
    "💀": "morte",
    "😮": "espanto",
    "😯": "espanto",
    "🤔": "dúvida",
    "💿": "disco",
    "📀": "disco",
    "🥤": "copo",
    "🔔": "sino",
    "🔕": "sino",
}
DROPPED = "️︎‍⃣"
SKIN = (0x1F3FB, 0x1F3FF)
EMOJI_PATTERN = r"[\p{So}\x{1F300}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}]"
NAME_CLASSES = {  # class -> words of a character's Unicode name, the first class counts
    "coração": {"HEART"},
    "bandeira": {"FLAG"},
    "morte": {"SKULL"},
    "fogo": {"FIRE"},
    "estrela": {"STAR"},
    "mão": {"CLAPPING", "THUMBS", "HAND", "HANDS", "FINGER", "FIST", "PALM", "ARM"},
    "animal": {"CAT", "DOG", "MONKEY", "ANIMAL"},
    "rosto": {"FACE", "SMILEY", "PERSON"},
}
GENERIC = "emoji"
# --------------------------------------------------------------------------------------------------------------

def canonical(x: Column) -> Column:
    """All white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def typography(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("…"), F.lit("...")), F.lit("´"), F.lit("'"))


def emoji_class(c: str) -> str:
    """Class by the words of the character's name."""
    name = set(unicodedata.name(c, "").replace("-", " ").split())
    return next((label for label, words in NAME_CLASSES.items() if words & name), GENERIC)


def spoken() -> dict[str, str]:
    """What stands for each emoji sequence and character: its word between blanks, nothing for joiners and skin tones.

    Made once from the fixed map and the names of all characters that EMOJI_PATTERN covers."""
    table = {}
    ranges = regex.compile(regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), EMOJI_PATTERN.replace(r"\p{So}", "")))
    for c in map(chr, range(0x20000)):
        if unicodedata.category(c) == "So" or ranges.match(c):
            table[c] = EMOJI.get(c) or emoji_class(c)
    silent = dict.fromkeys([*DROPPED, *map(chr, range(SKIN[0], SKIN[1] + 1))], "")
    return {k: f" {word} " for k, word in (table | EMOJI | SEQUENCES).items()} | silent


SPOKEN = spoken()
SYMBOLS = regex.compile("|".join(map(regex.escape, SEQUENCES)) + "|[" + "".join(map(regex.escape, (k for k in SPOKEN if len(k) == 1))) + "]")


def replace_emoji(text: str) -> str:
    return SYMBOLS.sub(lambda m: SPOKEN[m[0]], text)


@pandas_udf(StringType())
def emoji_to_words(x: pd.Series) -> pd.Series:
    return x.astype(object).map(lambda s: None if s is None else replace_emoji(s))


def model_text(x: Column) -> Column:
    """Typography, then emoji, then white space; empty for null. Plain Latin text takes no Python: the UDF sees null for it."""
    typed = typography(F.coalesce(x, F.lit("")))
    special = typed.rlike(r"[^\u0000-¥§ª-­¯±-ҁḀ-ỿ‐-‧]")
    return canonical(F.coalesce(emoji_to_words(F.when(special, typed)), typed))


@pandas_udf(StringType())
def fold_exact(x: pd.Series) -> pd.Series:
    """Without combining marks after compatibility decomposition."""
    return x.astype(object).map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


_LATIN = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and len([x for x in d if not unicodedata.combining(x)]) == 1]
_PLAIN = "".join(next(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in _LATIN)


@pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.astype(object).map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def lexicon_key(x: Column) -> Column:
    """Lower case in composed form, accents kept. Text without combining marks takes no Python: the UDF sees null for it."""
    low = F.lower(x)
    return F.coalesce(_composed(F.when(low.rlike(r"[\p{M}\u1100-\u11ff]"), low)), low)


def fold(x: Column) -> Column:
    """Accents dropped by translate(); exact for text of Latin letters below U+0250 without combining marks."""
    return F.translate(x, "".join(_LATIN), _PLAIN)


def twin_normalize(x: Column) -> Column:
    """Lower case, no accents, non-words to spaces, runs of one character to one, single spaces."""
    plain = F.regexp_replace(fold(F.lower(x)), r"(?U)[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(.)\1+", "$1"), r"\s+", " "))


def char_ngrams(x: Column, n: int = 3) -> Column:
    """Set of the n-grams of the space-padded text; none for an empty text."""
    padded = F.concat(F.lit(" "), x, F.lit(" "))
    grams = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # overlapping, in one pass
    return F.when(F.length(x) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def topic_clean(x: Column) -> Column:
    out = x
    for pattern in (URL, MENTION, TIMESTAMP, r"[\p{So}\p{Sk}\p{Cf}]"):
        out = F.regexp_replace(out, pattern, " ")
    return F.lower(out)


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def topic_tokens(x: Column, stopwords: Column) -> Column:
    """Tokens of cleaned text: long enough and no laughter before folding, no stopword after; repeats stay."""
    long = F.filter(words(x), lambda w: (F.length(w) >= MIN_TOKEN) & ~w.rlike(LAUGHTER))
    return F.filter(F.transform(long, fold), lambda w: ~F.array_contains(stopwords, w))


def only_tokens(rows: DataFrame, word: str, stopwords: list[str]) -> DataFrame:
    """rows, one a word of cleaned text, with the column token in place of the word; topic_tokens() says which stay."""
    kept = rows.where((F.length(word) >= MIN_TOKEN) & ~F.col(word).rlike(LAUGHTER))
    return kept.withColumn("token", fold(F.col(word))).where(~F.col("token").isin(*stopwords)).drop(word)


def lexicon_score(tokens: Column, lexicon: Column) -> Column:
    """Sum, label and matched terms of the tokens under a map of polarities."""
    found = F.filter(F.transform(tokens, lambda w: F.struct(w.alias("word"), lexicon[w].alias("polarity"))), lambda t: t["polarity"].isNotNull())
    total = F.aggregate(found, F.lit(0), lambda a, t: a + t["polarity"])
    label = F.when(total > 0, "positive").when(total < 0, "negative").otherwise("neutral")
    return F.struct(total.alias("score"), label.alias("label"), found.alias("terms"))


def justification(terms: Column, most: int = 8) -> Column:
    """'word (+1), ...' for the first terms, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(terms, 1, most), lambda t: F.format_string("%s (%+d)", t["word"], t["polarity"])), ", ")
    more = F.size(terms) - most
    return F.when(F.size(terms) == 0, F.lit("nenhuma palavra do lexico foi reconhecida neste comentario")).otherwise(
        F.concat(shown, F.when(more > 0, F.concat(F.lit(" e mais "), more.cast("string"))).otherwise(""))
    )


def confidence(shares: Column) -> Column:
    """'label 97%' parts of a map of shares, largest first, names breaking ties."""
    entries = F.array_sort(F.transform(F.map_entries(shares), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.concat(F.lit("confiança do modelo: "), F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit(" "), F.bround(-e["n"] * 100).cast("int").cast("string"), F.lit("%"))), " · "))


def nonlatin_strict(x: Column) -> Column:
    """At least 3 letters of which less than half are Latin."""
    letters, latin = F.length(F.regexp_replace(x, r"[^\p{L}]", "")), F.length(F.regexp_replace(x, r"[^\p{IsLatin}]", ""))
    return (letters >= 3) & (2 * latin < letters)


def latin_share_ok(x: Column) -> Column:
    """Half of the letters or more are Latin; text without letters passes."""
    letters, latin = F.length(F.regexp_replace(x, r"[^\p{L}]", "")), F.length(F.regexp_replace(x, r"[^\p{IsLatin}]", ""))
    return (letters == 0) | (latin >= 0.5 * letters)


def escape_like(term: Column) -> Column:
    """A LIKE pattern that finds the term literally."""
    out = term
    for c in ("\\", "%", "_"):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return F.concat(F.lit("%"), out, F.lit("%"))


def landis_koch(kappa: Column) -> Column:
    out = F.lit("quase perfeita")
    for limit, name in reversed([(0.0, "pobre"), (0.2, "leve"), (0.4, "razoavel"), (0.6, "moderada"), (0.8, "substancial")]):
        out = F.when(kappa < limit, name).otherwise(out)
    return out


def video_id(line: Column) -> Column:
    """Id of a bare id or of an address in one of the known forms, else null."""
    bare = F.trim(line)
    found = F.when(bare.rlike(r"^[A-Za-z0-9_-]{11}$"), bare)
    for pattern in (r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})"):
        found = F.coalesce(found, F.nullif(F.regexp_extract(bare, pattern, 1), F.lit("")))
    return found
