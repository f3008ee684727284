"""Text column expressions. All JVM-side (whole-stage codegen or native higher-order
functions); no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source application's behaviour:
#   - the training row id joins text and category with "||" and hashes with SHA-256
#   - tokens are runs of two or more word characters (letters, digits, underscore)
#   - n-grams are unigrams and adjacent bigrams joined by one space
ROW_ID_SEPARATOR = "||"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
BIGRAM_JOIN = " "

# The white space each side of the source application strips. Training runs
# use Python's str.strip(), the entry form JavaScript's trim() and \s. Spark's trim() strips
# U+0020 only and Java's \s is ASCII, so the characters are listed.
_SHARED_WS = "\t\n\u000b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
STRIP_WS = _SHARED_WS + "\u001c\u001d\u001e\u001f\u0085"
FORM_WS = _SHARED_WS + "\ufeff"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c, chars: str = STRIP_WS) -> Column:
    """Strip leading and trailing white space, Unicode spaces included (as str.strip;
    ``FORM_WS``: as the form's trim). Native trim with a character set: touches only the
    edges of long texts."""
    return F.trim(col_(c), F.lit(chars))


def _fold_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"[{FORM_WS}]+", " "), FORM_WS)


def clean_field(c) -> Column:
    """NULL becomes '' and the edges are stripped (training-side cleaning)."""
    return trim_ws(F.coalesce(col_(c), F.lit("")))


def text_of(vendor, description) -> Column:
    """``lower(strip(vendor) + ' ' + strip(description))`` stripped again.

    Inner whitespace runs are kept on purpose: training text is not collapsed.
    """
    return text_of_clean(clean_field(vendor), clean_field(description))


def text_of_clean(vendor, description) -> Column:
    """:func:`text_of` of fields that are stripped already: the ends of a joined text are theirs,
    so a long text is not walked again to strip it."""
    v, d = col_(vendor), col_(description)
    return F.lower(F.when(F.length(v) == 0, d).when(F.length(d) == 0, v).otherwise(F.concat(v, F.lit(" "), d)))


def row_id_of(text, category) -> Column:
    """Hex SHA-256 of ``text || '||' || category``: the learned-row identity.

    Declared non-null (inputs are coalesced upstream): a nullable computed join key
    makes the optimizer add an ``isnotnull`` filter below the projection, which would
    hash every whole text twice."""
    return F.coalesce(F.sha2(F.concat(col_(text), F.lit(ROW_ID_SEPARATOR), col_(category)), 256),
                      F.lit(""))


def normalized(c) -> Column:
    """UI normalisation: NULL to '', lower case, whitespace runs to one space, stripped."""
    return _fold_ws(F.lower(F.coalesce(col_(c), F.lit(""))))


def collapse_ws_keep_case(c) -> Column:
    """Whitespace runs to one space, stripped, case kept."""
    return _fold_ws(F.coalesce(col_(c), F.lit("")))


def title_words(c) -> Column:
    """Upper-case the first character of every space- and hyphen-separated part.

    Unlike ``initcap`` this capitalises after a hyphen ("Drop-In") and leaves the
    rest of each part untouched.
    """
    return F.array_join(
        F.transform(
            F.split(col_(c), " "),
            lambda w: F.array_join(
                F.transform(
                    F.split(w, "-"),
                    lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)),
                ),
                "-",
            ),
        ),
        " ",
    )


def tokens_of(text) -> Column:
    """Word tokens (>= 2 word characters) of the lower-cased text, whole text."""
    return F.regexp_extract_all(F.lower(col_(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def joined_tokens(text) -> Column:
    """The text's tokens in order, joined by one space (a token holds none); '' without any."""
    return F.coalesce(F.array_join(tokens_of(text), BIGRAM_JOIN), F.lit(""))


def ngram_array(text) -> Column:
    """Unigrams followed by adjacent bigrams, built without per-element lambdas:
    tokens are joined by one space (tokens hold no spaces) and every "token token"
    pair is captured by an overlapping look-ahead match."""
    toks = tokens_of(text)
    pairs = F.regexp_extract_all(F.array_join(toks, BIGRAM_JOIN), F.lit(_PAIR_RE), F.lit(1))
    return F.concat(toks, pairs)


_PAIR_RE = r"(?:^| )(?=([^ ]+ [^ ]+))"


def bucket_of(term, bits: int = 20) -> Column:
    """Stateless feature bucket: 32 bits of MD5 of the term, masked to ``bits``."""
    h = F.conv(F.substring(F.md5(col_(term)), 1, 8), 16, 10).cast("long")
    return h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
