"""Tokenisers, similarity and URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop-word list that the word counts leave out.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Characters that become spaces, by tokeniser.
CLASS_A, CLASS_B = r"[\(\[,\].!?:;\)]", r"[\(\[,\].!?:;\)\-&*%$0-9'~]"
# Fixed value: characters that the word counts of the two-label classifier delete.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def words_a(text: Column) -> Column:
    """Lower-case words after class-A punctuation; null gives null, an empty text an empty array."""
    return _words(F.regexp_replace(F.lower(text), CLASS_A, " "))


def words_b(text: Column) -> Column:
    return _words(F.regexp_replace(F.lower(text), CLASS_B, " "))


def words_az(text: Column) -> Column:
    """Runs of a-z in the lower-case text: one pass of a pattern, after which the text is letters and single spaces."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " "), "")


def words_joined(text: Column) -> Column:
    """Lower-case words with punctuation deleted, so that an apostrophe joins its sides."""
    return _words(F.translate(F.lower(text), PUNCTUATION, ""))


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def word_tag(token: Column) -> Column:
    """struct(word, tag) of ``word/TAG``, divided at the last slash."""
    return F.struct(F.regexp_extract(token, "^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract(token, "^(.*)/([^/]*)$", 2).alias("tag"))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def set_cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.sqrt(F.size(a)) * F.sqrt(F.size(b))), F.lit(0.0))


def link_trimmed(url: Column) -> Column:
    """The ranking study's link form: characters of the scheme are trimmed one by one, as a set, then those of ``www.``, then slashes at the end."""
    return F.rtrim(F.ltrim(F.ltrim(F.ltrim(url, F.lit("https://")), F.lit("http://")), F.lit("www.")), F.lit("/"))


def url_normalized(url: Column) -> Column:
    """Scheme and host in lower case, no default port, a path at least."""
    scheme, host, rest = (F.regexp_extract(url, r"^([A-Za-z]+)://([^/?#]*)(.*)$", i) for i in (1, 2, 3))
    port = F.when(F.lower(scheme) == "http", F.regexp_replace(F.lower(host), ":80$", "")).otherwise(F.regexp_replace(F.lower(host), ":443$", ""))
    return F.when(scheme == "", url).otherwise(F.concat(F.lower(scheme), F.lit("://"), port, F.when(rest == "", "/").otherwise(rest)))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two texts of one length differ; null for others."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)))


def bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two numbers differ."""
    return F.bit_count(a.bitwiseXOR(b))


#: Bits of a fingerprint: so many hexadecimal digits of a word's MD5, below the sign of a long.
HEX = 15


def word_bits(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, HEX), 16, 10).cast("long")
