"""Column functions that clean and compare titles and artist names.

All are built from Spark's own functions, but for three that need Python's codecs or Unicode tables
(``repair_mojibake``, ``nfkc`` and ``lcs_length``); those run on Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers of promotional text.
PROMO_PHRASES = (
    "公众号", "微信公众号", "微信", "威信", "VX", "vx", "V信", "加群", "进群", "入群", "粉丝群", "群号", "抖音", "快手", "关注", "扫码", "扫一扫",
    "添加好友", "免费下载", "音乐网", "车载专用", "www.", "http", "严禁商用", "仅供试听", "上传", "推广", "收藏", "资源库",
)
# Separators between a title and an artist, in order of preference among equal lengths.
SEPARATORS = (" - ", " – ", " — ", "－", "-", "–", "—", "_", "|", "／", "/", "·")
# Stand-ins for a missing value, by the place that uses them.
UNKNOWN_TEXTS = ("[unknown artist]", "[unknown album]", "unknown artist", "unknown album", "未知艺术家", "未知专辑", "未知", "various artists", "<unknown>")
PSEUDO_VALUES = ("[Unknown Artist]", "[Unknown Album]", "Unknown Artist", "Unknown Album", "unknown", "N/A", "n/a", "-", "")
PSEUDO_ARTISTS = ("cydian", "unknown artist", "unknown", "various artists", "群星", "未知艺术家", "未知歌手", "无", "none", "null")
PLACEHOLDER_ALBUMS = ("律动车载音乐", "车载音乐", "music", "unknown album", "未知专辑", "我的音乐", "无损音乐")
# Content flags and what they look for.
FLAG_PATTERNS = {
    "isLive": "(?i)(live|现场|演唱会|音乐会|live版)",
    "isRemix": "(?i)(remix|dj|混音|电音版|改编版|remix版)",
    "isInstrumental": "(?i)(纯音乐|伴奏|无人声|instrumental|karaoke|off ?vocal)",
    "isCover": "(?i)(翻唱|cover by|cover版)",
}

# Longest folder names that count as an artist and an album; bracket signs; CJK blocks; what joins artists' names.
ARTIST_LENGTH, ALBUM_LENGTH = 40, 60
_OPEN, _CLOSE = r"【\[（(《<「『〔", r"】\]）)》>」』〕"
_BRACKET = r"[【】\[\]（）()《》<>「」『』〔〕]"
_GROUP = rf"[{_OPEN}][^{_CLOSE}]*[{_CLOSE}]"
_CJK = r"[㐀-䶿一-鿿豈-﫿]"
_HIGH = r"[ -ÿ]"
# Accented letters as words have them, a capital in front only, next to an unaccented letter: no bytes of another encoding.
_ACCENTED = r"[À-ÖØ-Þ]?[ß-öø-ÿ]+"
# Words of small accented letters alone, a capital in front of up to two: common Chinese characters begin with a byte that is none.
_LONE = rf"(?<!{_HIGH})(?:[À-ÖØ-Þ][ß-öø-ÿ]{{1,2}}|[ß-öø-ÿ]+)(?!{_HIGH})"
_LATIN_WORD = rf"(?<=[A-Za-z]){_ACCENTED}(?!{_HIGH})|(?<!{_HIGH}){_ACCENTED}(?=[A-Za-z])|{_LONE}"
_ARTIST_CUT = r"(?i)[/、&,;]|\bfeat\.?\b|\bft\.?\b"


_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "


def _quoted(words) -> str:
    return "|".join("\\Q" + w + "\\E" for w in words)


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cjk_count(c: Column) -> Column:
    return F.regexp_count(blank(c), F.lit(_CJK))


def has_cjk(c: Column) -> Column:
    return blank(c).rlike(_CJK)


def may_be_garbled(c: Column) -> Column:
    """The tests for text in the wrong encoding that need no decoding: Latin-1 only, dense high characters in pairs.

    Pairs inside Latin words, such as those of ``créé`` and ``çê``, don't count.
    """
    s = blank(c)
    high = F.regexp_count(s, F.lit(_HIGH))
    span = F.char_length(F.regexp_extract(s, f"(?s){_HIGH}.*{_HIGH}", 0))
    pairs = F.regexp_count(F.regexp_replace(s, _LATIN_WORD, " "), F.lit(f"(?={_HIGH}{_HIGH}){_HIGH}"))
    return (high >= 2) & ~s.rlike(r"[^\x00-\x{ff}]") & (high >= 0.5 * span) & (pairs >= 2)


@F.pandas_udf(T.StringType())
def _redecode(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        try:
            return unicodedata.normalize("NFC", x.encode("latin-1").decode("gb18030"))
        except UnicodeError:
            return None

    return s.map(one)


def repair_mojibake(c: Column) -> Column:
    """Text whose GB18030 bytes were read as Latin-1, read again; other text as it is. Python sees suspicious rows' text only."""
    decoded = _redecode(F.when(may_be_garbled(c), c))
    better = (cjk_count(decoded) >= 2) & (cjk_count(decoded) > cjk_count(c)) & ~F.contains(decoded, F.lit("�"))
    return F.when(may_be_garbled(c) & decoded.isNotNull() & better, decoded).otherwise(c)


def is_garbled(c: Column) -> Column:
    return F.coalesce(repair_mojibake(c) != c, F.lit(False))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _compatible_form(c: Column) -> Column:
    """NFKC; Python sees only texts with a character beyond ASCII, the others are in that form."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def normalize(c: Column, fold: bool = True, repair: bool = True) -> Column:
    """For comparing: broken encodings repaired, compatibility forms folded, lower case, no brackets, one space for runs of
    other than letters and digits.

    ``fold=False`` folds full-width ASCII only; with ``repair=False`` besides, for text that is repaired, there is no Python step.
    """
    s = blank(repair_mojibake(c) if repair else c)
    s = _compatible_form(s) if fold else F.translate(s, _WIDE, _NARROW)
    s = F.regexp_replace(F.lower(s), _BRACKET, " ")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def squeeze(c: Column, fold: bool = True, repair: bool = True) -> Column:
    return F.replace(normalize(c, fold, repair), F.lit(" "), F.lit(""))


def is_promo(c: Column, repair: bool = True) -> Column:
    return blank(repair_mojibake(c) if repair else c).rlike(_quoted(PROMO_PHRASES))


def is_unknown(c: Column) -> Column:
    s = F.trim(F.lower(blank(c)))
    return (s == "") | s.isin(*UNKNOWN_TEXTS)


def is_pseudo(c: Column, kind: str = "string") -> Column:
    """Missing by type: null; 0 for numbers; empty for arrays; a stand-in for strings."""
    if kind == "number":
        return c.isNull() | (c == 0)
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | F.trim(c).isin(*PSEUDO_VALUES)


def is_pseudo_artist(c: Column) -> Column:
    s = F.trim(blank(c))
    return (s == "") | F.lower(s).isin(*PSEUDO_ARTISTS) | s.isin(*PSEUDO_VALUES)


def is_placeholder_album(c: Column) -> Column:
    return F.lower(F.trim(blank(c))).isin(*PLACEHOLDER_ALBUMS)


def _cut_at(s: Column, sep: str) -> tuple[Column, Column, Column]:
    """(usable, left, right) of the first place of ``sep``, if text stands on both sides."""
    at = F.locate(sep, s)
    left, right = F.trim(F.substring(s, F.lit(1), at - 1)), F.trim(F.substring(s, at + len(sep), F.char_length(s)))
    return (at > 1) & (left != "") & (right != ""), left, right


def has_separator(c: Column, repair: bool = True) -> Column:
    s = blank(repair_mojibake(c) if repair else c)
    found = F.lit(False)
    for sep in SEPARATORS:
        found = found | _cut_at(s, sep)[0]
    return found


def strip_track_number(c: Column) -> Column:
    s = F.regexp_replace(blank(c), r"^\s*\d{1,3}\s*[.\-_、]\s*", "")
    return F.trim(F.regexp_replace(s, r"^\s*\d{1,3}\s+(?=[一-鿿])", ""))


def strip_brackets(c: Column) -> Column:
    """Bracket signs go, what they hold stays."""
    return squash(F.regexp_replace(blank(c), _BRACKET, " "))


def strip_leading_groups(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(blank(c)), rf"^(?:{_GROUP}\s*){{1,6}}", ""))


def strip_trailing_groups(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(blank(c)), rf"(?:\s*{_GROUP}){{1,6}}\s*$", ""))


def split_title(c: Column, known: Column | None = None, repair: bool = True) -> Column:
    """struct(titles, artists): ordered guesses from a raw title; ``known`` is an artist to look for on either side."""
    raw = strip_brackets(repair_mojibake(c) if repair else c)
    ranked = sorted(range(len(SEPARATORS)), key=lambda i: (-len(SEPARATORS[i]), i))

    def cut(x: Column) -> Column:
        left = right = F.lit(None).cast("string")
        for i in reversed(ranked):
            usable, a, b = _cut_at(x["raw"], SEPARATORS[i])
            left, right = F.when(usable, a).otherwise(left), F.when(usable, b).otherwise(right)
        return F.struct(x["raw"].alias("raw"), left.alias("left"), right.alias("right"), x["want"].alias("want"))

    def guess(x: Column) -> Column:
        bare = strip_track_number(x["left"])
        number = x["left"].rlike(r"^[.\-_\s]*\d{1,3}[.\-_]?$") | x["left"].rlike(r"^\d{1,3}[.\-_]")
        want = x["want"]
        is_left, is_right = (want != "") & (squeeze(bare, False, False) == want), (want != "") & (squeeze(x["right"], False, False) == want)
        none = F.array().cast("array<string>")
        titles = (
            F.when(x["left"].isNull(), F.array(x["raw"])).when(number, F.array(x["right"], x["raw"])).when(is_left, F.array(x["right"], x["raw"]))
            .when(is_right, F.array(bare, x["raw"])).otherwise(F.array(bare, x["right"], x["raw"]))
        )
        artists = F.when(x["left"].isNull() | number, none).when(is_left, F.array(bare)).otherwise(F.array(x["right"]))
        tidy = lambda a: F.array_distinct(F.filter(a, lambda t: t != ""))
        return F.struct(tidy(titles).alias("titles"), tidy(artists).alias("artists"))

    # what a Python step may have made comes in through the struct, once: a lambda can't hold such a step
    want = squeeze(known, False, False) if known is not None else F.lit("")
    given = F.struct(raw.alias("raw"), want.alias("want"))
    return F.element_at(F.transform(F.transform(F.array(given), cut), guess), 1)


def title_queries(title: Column, artist: Column, repair: bool = True) -> Column:
    """array<struct(strategy, q)>: S1 the best cleaned title, S2 with the artist, S3 the other forms."""
    if repair:  # once, outside of what uses it many times
        given = F.struct(repair_mojibake(title).alias("title"), repair_mojibake(artist).alias("artist"))
        return F.element_at(F.transform(F.array(given), lambda x: title_queries(x["title"], x["artist"], False)), 1)
    usable = ~is_promo(artist, False) & ~is_unknown(artist)
    known = F.when(usable, F.trim(artist)).otherwise(F.lit(""))
    tidy = lambda s: F.trim(F.regexp_replace(F.regexp_replace(squash(s), r"^[\s\-–—_|/·、.]+", ""), r"[\s\-–—_|/·]+$", ""))

    def forms(t: Column) -> Column:
        bare = strip_track_number(t)
        lead = strip_leading_groups(bare)
        return F.array(tidy(bare), tidy(lead), tidy(strip_trailing_groups(lead)))

    lead = strip_leading_groups(title)
    variants = lambda t: F.flatten(F.transform(split_title(t, known, False)["titles"], forms))
    first = F.when((lead != "") & (lead != blank(title)), variants(lead)).otherwise(F.array().cast("array<string>"))
    candidates = F.array_distinct(F.filter(F.concat(first, variants(title)), lambda t: t != ""))

    def queries(x: Column) -> Column:
        cs, usable, known = x["cs"], x["usable"], x["known"]
        one = F.coalesce(F.get(cs, 0), F.lit(""))
        rest = F.slice(cs, 2, F.greatest(F.size(cs), F.lit(1)))
        query = lambda s, q: F.struct(F.lit(s).alias("strategy"), squash(q).alias("q"))
        none = F.filter(F.array(query("", F.lit(""))), lambda _: F.lit(False))
        out = F.concat(
            F.array(query("S1", one)), F.when(usable, F.array(query("S2", F.concat(one, F.lit(" "), known)))).otherwise(none),
            F.transform(rest, lambda c: query("S3", c)), F.when(usable, F.transform(rest, lambda c: query("S3", F.concat(c, F.lit(" "), known)))).otherwise(none),
        )
        return F.array_distinct(F.filter(out, lambda x: x["q"] != ""))

    given = F.struct(candidates.alias("cs"), usable.alias("usable"), known.alias("known"))
    return F.element_at(F.transform(F.array(given), queries), 1)


def title_similarity(a: Column, b: Column) -> Column:
    """0 to 1 for squeezed texts: edit distance by length, or a bonus if one holds the other."""
    shorter, longer = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    ratio = 1 - F.levenshtein(a, b) / longer
    held = (shorter >= 2) & (F.contains(a, b) | F.contains(b, a))
    return F.when((blank(a) == "") | (blank(b) == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(held, F.greatest(ratio, 0.75 + 0.25 * (shorter / longer))).otherwise(ratio)


def artist_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(blank(c), _ARTIST_CUT), lambda x: F.trim(x)), lambda x: x != "")


def squeezed_parts(c: Column) -> Column:
    return F.transform(artist_parts(c), lambda x: squeeze(x, False, False))


def parts_similarity(a: Column, b: Column) -> Column:
    """The best similarity of any two of the squeezed parts of two names, 0 without any."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: title_similarity(x, y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def artist_similarity(a: Column, b: Column) -> Column:
    """The best similarity of any two parts of names joined by / 、 & , ; feat. or ft. (without compatibility folding)."""
    return parts_similarity(squeezed_parts(a), squeezed_parts(b))


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; a row of the usual table is the bits of one number."""

    def one(x, y):
        if not x or not y:
            return 0
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        row = full = (1 << len(x)) - 1
        for d in y:
            same = row & places.get(d, 0)
            row = (row + same) | (row - same)
        return len(x) - (row & full).bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the multisets of characters."""
    x, y = F.split(a, ""), F.split(b, "")
    times = lambda s, c: F.size(F.filter(s, lambda d: d == c))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, c: n + F.least(times(x, c), times(y, c)))
    either = F.char_length(a) + F.char_length(b) - both
    return F.when((blank(a) == "") | (blank(b) == ""), F.lit(0.0)).otherwise(both / either)


def audit_similarity(a: Column, b: Column) -> Column:
    """A second opinion on title similarity: common subsequence, shared characters, or containment."""
    shorter, longer = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    held = F.when(F.contains(a, b) | F.contains(b, a), 0.72 + 0.28 * (shorter / longer)).otherwise(F.lit(0.0))
    return F.when((blank(a) == "") | (blank(b) == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(lcs_length(a, b) / longer, char_jaccard(a, b), held))


def compare_artists(a: Column, b: Column) -> Column:
    """same, variant (equal lengths, one CJK character apart) or different, dashes and punctuation aside."""
    fold = lambda c: F.regexp_replace(F.lower(blank(c)), r"[\s\p{P}\p{S}]+", "")
    x, y = fold(a), fold(b)
    apart = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda c, d: c != d), lambda z: z))
    near = (F.char_length(x) == F.char_length(y)) & (apart == 1) & has_cjk(x) & has_cjk(y)
    return F.when((x != "") & (x == y), F.lit("same")).when(near, F.lit("variant")).otherwise(F.lit("different"))


def artist_verdict(a: Column, b: Column) -> Column:
    """exact, near or none for the best pair of parts: equal; one holds the other; close spellings."""
    bare = lambda x: squeeze(x, False, False)

    def pair(x: Column, y: Column) -> Column:
        p, q = bare(x), bare(y)
        longer = F.greatest(F.char_length(p), F.char_length(q))
        ratio = 1 - F.levenshtein(p, q) / longer
        some = (p != "") & (q != "")
        held = F.contains(p, q) | F.contains(q, p)
        short = has_cjk(p) & has_cjk(q) & (F.char_length(p) == F.char_length(q)) & (longer <= 4) & (F.levenshtein(p, q) == 1)
        return F.when(some & (p == q), 2).when(some & (held | short | (~has_cjk(p) & (ratio >= 0.8))), 1).otherwise(0)

    best = F.array_max(F.flatten(F.transform(artist_parts(a), lambda x: F.transform(artist_parts(b), lambda y: pair(x, y)))))
    return F.element_at(F.array(F.lit("none"), F.lit("near"), F.lit("exact")), F.coalesce(best, F.lit(0)) + 1)


def fold_script(c: Column, traditional: str, simplified: str) -> Column:
    """Characters of one string replaced by those at the same places of another."""
    return F.translate(c, traditional, simplified)


def loose_name(c: Column) -> Column:
    """A key for library matching: lower case, no white space, nothing in round brackets."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"\s+", ""), r"[（(][^）)]*[）)]", "")


def file_core(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank(c), r"\.[a-zA-Z0-9]{1,5}$", ""))


def file_title(c: Column) -> Column:
    return F.trim(F.get(F.split(file_core(c), r"\s+[-–—]\s+"), 0))


def strip_extension(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank(c), r"\.[^.]+$", ""))


def title_segments(c: Column) -> Column:
    """struct(head, tail) of "head - tail" with a head of at most 14 characters; nulls otherwise."""
    pattern = r"^\s*(.{1,14}?)\s*[-–—]\s*(.+?)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(blank(c), pattern, i), F.lit(""))
    return F.struct(part(1).alias("head"), part(2).alias("tail"))


def path_parts(c: Column) -> Column:
    return F.filter(F.split(blank(c), "/"), lambda x: x != "")


def infer_from_path(path: Column, depth: Column, least_depth: int = 2) -> Column:
    """struct(artist, album) from the first two folders of artist/album/file, where they look like names."""
    parts = path_parts(path)
    deep = (F.size(parts) >= 3) & (depth >= least_depth)
    a, b = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    artist = F.when(deep & ~is_pseudo_artist(a) & ~is_promo(a, False) & (F.char_length(a) <= ARTIST_LENGTH), a)
    album = F.when(deep & (b != "") & ~is_placeholder_album(b) & (F.char_length(b) <= ALBUM_LENGTH), b)
    return F.struct(artist.alias("artist"), album.alias("album"))


def split_path(c: Column) -> Column:
    """struct(artistDir, albumDir, fileName): the last three parts of a path."""
    parts = path_parts(c)
    at = lambda n: F.get(parts, F.size(parts) - n)
    return F.struct(at(3).alias("artistDir"), at(2).alias("albumDir"), at(1).alias("fileName"))


def same_label(a: Column, b: Column, fold: bool = True) -> Column:
    """Equal but for case, spacing and decoration, and neither empty."""
    x = squeeze(a, fold)
    return (x != "") & (x == squeeze(b, fold))


def content_flags(*texts: Column) -> dict[str, Column]:
    hay = F.concat_ws(" ", *(blank(t) for t in texts))
    return {name: hay.rlike(pattern) for name, pattern in FLAG_PATTERNS.items()}


def sanitize_lyrics(c: Column, most: int = 50 * 1024) -> Column:
    s = F.regexp_replace(blank(c), r"(?i)<script[\s\S]*?</script>", "")
    s = F.replace(F.regexp_replace(s, "<[^>]+>", ""), F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.substring(s, 1, most), r"^\s+|\s+$", "")


def has_timeline(c: Column) -> Column:
    return blank(c).rlike(r"\[\d{1,2}:\d{2}")


def escape_query(c: Column) -> Column:
    return F.regexp_replace(blank(c), r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def structured_query(title: Column, artist: Column) -> Column:
    """recording:"title" AND artist:"artist", or the title alone."""
    one = F.concat(F.lit('recording:"'), escape_query(title), F.lit('"'))
    return F.when(is_unknown(artist), one).otherwise(F.concat(one, F.lit(' AND artist:"'), escape_query(artist), F.lit('"')))
