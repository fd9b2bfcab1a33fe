"""Keyword-stuffed and link-list pages by a robust Mahalanobis distance.

A text is read as tokens in their surroundings (a window of 15 tokens).
Words in surroundings poor in function words and in data, or in which the
same words keep coming back, count as keywords; links outside of sentences
and tags (hash tags, prices, article numbers) count as such. The features
of a page are the shares of its characters in keywords, links, tags and
close repetitions, its rate of function words, its word entropy and its
share of data (numbers, residues, flags, file names). Disguises are undone
first: zero-width characters, compatibility forms, letters of another
script inside a word, figures for letters, "dot" for a point.

Function words are fixed lists and, in languages that these don't reach,
short words found on many of the language's pages. As long as too few pages
of a language show function words to tell its sentences, only words that
come back on the page count as keywords.

Per language the centre (median) and scatter of the features are estimated
from the half of the pages closest to the centre, so pages of spam don't
move them. All decisions are robust Mahalanobis distances in the metric of
the page's language: an outlier (its distance from the centre is beyond a
quantile of the chi-squared distribution) is flagged if it lies in a
direction of spam, that is nearer to its spam pole than to the centre and to
the data pole. The spam pole is the page of nothing but keywords, links,
tags and repetitions in this page's own mixture, without function words; the
data pole is the page of nothing but data. Dumps, logs and tables are as far
from prose as spam, but elsewhere. Being nearer to the pole than to the
centre is to have covered half of the way, which is what "most of the text"
means in that metric. Small pages are judged as if a little ordinary prose
stood beside them, by the same rule at every size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.session import Stage, ship, small

# Common function words; prepositions that trade idioms are made of ("for sale", "near you") are left out.
FUNCTION_WORDS = frozenset(
    """
    the a an of to is it and or not as at by from that this which while if because since so be are was were has have had but than then when where who whose what why
    how here two its do does did we they their he she one every each before after between into over under until even although though still already these those there
    isn't doesn't don't can could would should will may might must been being both some such other only also more most
    der die das und ist nicht ein eine einer eines einem einen zu den dem des mit auf von bei nach aus weil wird wurde werden dass wir sie es ob bis zur zum
    obwohl dort dennoch als auch noch wie über unter zwischen aber oder wenn sind war hat haben
    le la les l du des un une et est que qui dans sur avec nous au aux ne se sa son ses ce cette où déjà jusqu'à plus il elle mais ou sont été avons
    el los las del y se un una es con su al lo como más pero porque hasta aunque según tras qué por que sin esta este son fue
    и в на с по не что как это мы из от до за при но же так к у о мой его её их для если или был была было
    """.split()
)
# Frequent function characters of Chinese and Japanese.
FUNCTION_CHARACTERS = frozenset("的了从到在是和我们其中这与有不对为第个最也都就而以于之及或被把向让は が を に の と で も から まで です ます".replace(" ", ""))
# Cyrillic and Greek letters that look like the Latin ones below them.
_FOREIGN = "асеорхуівкмнтԁһјѕԛԝАВЕКМНОРСТХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LOOKALIKES = str.maketrans(_FOREIGN, "aceopxyibkmhtdhjsqwABEKMHOPCTXIJSaeiknoptuxABEZHIKMNOPTYX")
# Figures and signs written for letters.
_FIGURES = str.maketrans("@!$013457", "aisoleast")
# Usual endings of file names, which are no domains.
_FILES = "avi|bam|bat|bin|bmp|bz2|cfg|cif|conf|cpp|csv|dat|db|doc|docx|exe|fa|fasta|gif|gz|hhm|hmm|hpp|html?|ini|ipynb|jar|java|jpe?g|js|json|jsonl|log|md|mp3|mp4|npy|npz|ods|odt|out|parquet|pdb|pdf|php|pkl|png|ppt|pptx|ps|py|rar|rst|sh|sql|sqlite|sto|svg|tar|tex|tiff?|tmp|toml|tsv|txt|wav|xls|xlsx|xml|ya?ml|zip|zst"

KEYS = ("keywords", "links", "tags", "repeats", "function_words", "entropy", "data")
SPAM_KEYS = ("keywords", "links", "tags", "repeats")
#: Smallest scale of a feature (shares that are 0 on most pages have no scatter), in KEYS' order.
FLOORS = np.array([0.08, 0.04, 0.04, 0.05, 0.08, 0.08, 0.08])
WINDOW, NEAR = 15, 5
FUNCTION_RATE, PROSE_RATE, DATA_RATE, REPEAT_RATE = 0.15, 0.3, 0.2, 0.25
DISTANCE_SQUARED = 18.48  # 99 % quantile of chi-squared with 7 degrees of freedom
DIGIT_SHARE = 0.4
#: Characters and tokens of the language's ordinary prose that are thought to stand beside every page.
PRIOR_CHARACTERS, PRIOR_TOKENS = 80, 2
#: A page without any keywords, links, tags and repetitions is measured against the pole of keywords; that weight is counted along.
KEYWORD_PRIOR = 0.02
#: Estimated function words: letters at most, least share of the language's pages, pages without any that are counted along, words a language at most.
SHORT, SPREAD, SPREAD_PAGES, MOST_WORDS = 5, 0.25, 30, 40
#: A word comes back if it is on the page so many times and makes up that share of its words; pages without function words counted along with those of a language.
COMES_BACK, BACK_SHARE, UNKNOWN_PAGES = 3, 0.015, 2
_WORD, _FUNCTION, _DATA, _TAG, _LINK, _OTHER = range(6)
_KEPT = 1 << 18
#: A token is a number: kind (4 bits), characters (31 bits, all that a string column holds), word number.
_WORD_AT, _SIZE_MASK = 35, (1 << 31) - 1

_LINK_RE = re.compile(rf"(?:h(?:tt|xx)ps?:/|www\.)[^\s\"'<>\[\]()]*(?:\[\.\][^\s\"'<>\[\]()]*)*|[\w-]*(?:\[?\.\]?[\w-]+)*\[?\.\]?(?!(?:{_FILES})\b)[a-z]{{3,8}}(?:/[^\s\"'<>\[\]()]*)?$", re.I)
_LETTERS = re.compile(r"[^\W\d_]")
_NEIGHBOURS = re.compile(rf"[a-zA-Z][{_FOREIGN}]|[{_FOREIGN}][a-zA-Z]")
_CJK = re.compile(r"([぀-ヿ㐀-鿿가-힣])")
_FIGURED = re.compile(r"[^\W\d_]*[@!$013457]+[^\W\d_]+[\w@!$]*")
_HIDDEN = regex.compile(r"\p{Cf}+")
_MIXED = re.compile(r"[^\W\d_]+")
_DOT = re.compile(r"(?<=\w)\s+(?:dot|\(dot\)|\[dot\])\s+(?=\w)", re.I)
# Vowel signs and other marks that belong to a word but aren't \w.
_MARKS = "\u0300-\u036f\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0963\u0966-\u0df3\u0e00-\u0e4e\u0eb1-\u0ece\u102b-\u103e\u17b4-\u17d3"
_JOINERS = re.compile(rf"[^\w{_MARKS}@#$€£*'-]+|_+|--+")
_DATA_RE = re.compile(rf"--?\w[\w-]*(?:=.*)?|\w+=\S+|\S*\w\.(?:{_FILES})\b\S*|(?=[A-Z*-]*[B-DF-HJ-NP-TV-XZ]{{5}})[A-Z*-]{{12,}}|[A-Z*-]{{25,}}|[\[(]?\d\d:\d\d\S*|-+>")
_MARKUP = re.compile(r"</?\w+>?|\[/?\w+\]")
_PRICE = re.compile(r"[$€£]\s?\d[\d.,]*|\d[\d.,]*\s?[$€£]|SKU-?\d+|(?:USD|EUR|GBP)")


def undisguise(text: str) -> str:
    """Compatibility forms, invisible characters and foreign look-alike letters undone."""
    if text.isascii():
        return _DOT.sub(".", text) if "dot" in text or "DOT" in text else text
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if _NEIGHBOURS.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_LOOKALIKES) if _NEIGHBOURS.search(m[0]) else m[0], text)
    if _CJK.search(text):
        text = _CJK.sub(r" \1 ", text)
    return _DOT.sub(".", text) if "dot" in text or "DOT" in text else text


class Reader:
    """Tokens of texts as (kind, characters, word number), with a bounded table of what was seen."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, int] = {}
        self.names: list[str] = []

    def _code(self, kind: int, size: int, word: str = "") -> int:
        n = self.words.setdefault(word, len(self.words) + 1) if word else 0
        if n > len(self.names):
            self.names.append(word)
        return n << _WORD_AT | size << 4 | kind

    def _plain(self, part: str) -> Iterator[int]:
        if not part:
            return
        low = part.lower().strip("'-")
        if low in FUNCTION_WORDS or low in FUNCTION_CHARACTERS:
            yield self._code(_FUNCTION, len(part))
        elif part[0] in "#@" and len(part) > 2:
            yield self._code(_TAG, len(part), low)
        elif _PRICE.fullmatch(part):
            yield self._code(_TAG, len(part))
        elif digits := sum(c.isdigit() for c in part):
            if len(part) > 2 and digits < DIGIT_SHARE * len(part):  # 2x-faster, 10-pack, fr33
                yield self._code(_WORD, len(part), low.translate(_FIGURES))
            else:
                yield self._code(_OTHER if len(part) <= 2 else _DATA, len(part))
        elif _LETTERS.search(part):
            yield self._code(_OTHER if len(low) == 1 and not _CJK.match(low) else _WORD, len(part), low)
        elif part.strip("'-"):
            yield self._code(_OTHER, len(part))

    def _token(self, token: str) -> tuple[int, ...]:
        given = token
        if _FIGURED.fullmatch(token.strip(".,;:!?")) and token[0] not in "#$" and sum(c.isalpha() for c in token) >= 2 and not any(c in "2689" for c in token):
            token = token.rstrip(".,;:!?").translate(_FIGURES)
        token = _MARKUP.sub(" ", token).strip()
        bare = token.strip(".,;:()\"'“”«»")
        if not bare:
            found: tuple[int, ...] = ()
        elif m := (_LINK_RE.search(bare) if "/" in bare or "." in bare else None):
            before, after = bare[: m.start()], bare[m.end() :]
            before = re.sub(r"(?:href=|url=).?$", "", before)
            found = (*chain.from_iterable(map(self._plain, _JOINERS.split(before))), self._code(_LINK, len(m[0])), *chain.from_iterable(map(self._plain, _JOINERS.split(after))))
        elif _DATA_RE.fullmatch(token) or _DATA_RE.fullmatch(bare):
            found = (self._code(_DATA, len(token)),)
        elif _PRICE.fullmatch(bare):
            found = (self._code(_TAG, len(bare)),)
        elif re.fullmatch(r"[\d.,:%/×x+-]+|\w*\d[\d.:/]*\d\w*", bare) and len(bare) > 2:
            found = (self._code(_DATA, len(bare)),)
        else:
            found = tuple(chain.from_iterable(map(self._plain, _JOINERS.split(token))))
        if len(given) <= 64:
            self.known[given] = found
        return found

    def read(self, text: str) -> list[int]:
        tokens = undisguise(text).split()
        found = list(map(self.known.get, tokens))
        if None in found:
            found = [self._token(t) if f is None else f for t, f in zip(tokens, found)]
        return list(chain.from_iterable(found))

    def forget(self) -> None:
        """Between batches: word numbers only compare words of one text."""
        if len(self.known) > _KEPT or len(self.words) > _KEPT:
            self.known.clear()
            self.words.clear()
            self.names.clear()


def features(texts: list[str | None], reader: Reader, more: list[frozenset[str] | None] | None = None, recurring: bool = False) -> np.ndarray:
    """[text, KEYS + number of tokens]; nothing gives zeros. All texts of a batch are worked on at once.

    ``more`` has further function words of every text, ``recurring`` puts
    the share of keywords that come back on the page before the tokens.
    """
    coded = [reader.read(t) if t else [] for t in texts]
    for i, words in enumerate(more or []):
        if words:
            numbers = {reader.words.get(w) for w in words}
            coded[i] = [c & _SIZE_MASK << 4 | _FUNCTION if c & 15 == _WORD and c >> _WORD_AT in numbers else c for c in coded[i]]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    code = np.fromiter(chain.from_iterable(coded), np.int64, int(sizes.sum()))
    reader.forget()
    out = np.zeros((len(texts), len(KEYS) + 1 + recurring))
    out[:, -1] = sizes
    if not len(code):
        return out
    doc = np.repeat(np.arange(len(texts)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = begin + np.repeat(sizes, sizes)
    kind, size, word = code & 15, (code >> 4 & _SIZE_MASK).astype(np.float64), code >> _WORD_AT
    at = np.arange(len(code))
    low, high = np.maximum(begin, at - WINDOW // 2), np.minimum(end, at + WINDOW // 2 + 1)

    def around(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag)]
        return total[high] - total[low]

    content, function, data = kind == _WORD, kind == _FUNCTION, kind == _DATA
    named = content | (kind == _TAG)
    order = np.lexsort((at, word, doc))
    again = np.zeros(len(code), bool)
    a, b = order[:-1], order[1:]
    again[b] = (doc[a] == doc[b]) & (word[a] == word[b]) & (b - a <= NEAR) & named[a] & named[b] & (word[b] > 0)
    n_words, n_function, n_data = around(content | function), around(function), around(data)
    n_all = high - low
    foreign = around((kind == _LINK) | (kind == _TAG))  # a sentence with links needs more function words
    sentence = (n_words >= 5) & (n_function >= FUNCTION_RATE * n_words + foreign / 2)
    in_data = n_data >= DATA_RATE * n_all
    repeated = around(again) >= REPEAT_RATE * np.maximum(1, around(named))
    repeated &= ~in_data & (around(named) >= 4) & (n_function < PROSE_RATE * n_words)
    total = np.maximum(1, np.bincount(doc, size, len(texts)))
    share = lambda flag: np.bincount(doc[flag], size[flag], len(texts)) / total
    keyword = content & ~sentence & ~in_data & ~repeated
    out[:, 0] = share(keyword)
    out[:, 1] = share((kind == _LINK) & ~sentence)
    out[:, 2] = share((kind == _TAG) & ~sentence)
    out[:, 3] = share((content | function) & repeated)
    out[:, 6] = share(data | ((content | (kind == _OTHER)) & in_data))
    words = np.maximum(1, np.bincount(doc[content | function], minlength=len(texts)))
    out[:, 4] = np.bincount(doc[function], minlength=len(texts)) / words
    text_word = doc[named] * (int(word.max(initial=0)) + 1) + word[named]
    kinds, inverse, counts = np.unique(text_word, return_inverse=True, return_counts=True)
    owner = kinds // (int(word.max(initial=0)) + 1)
    n = np.maximum(1, np.bincount(owner, counts, len(texts)))
    if recurring:
        back = np.zeros(len(code), bool)
        back[named] = (counts >= np.maximum(COMES_BACK, BACK_SHARE * n[owner]))[inverse]
        out[:, -2] = share(keyword & back & (word > 0))
    p = counts / n[owner]
    out[:, 5] = -np.bincount(owner, p * np.log2(p), len(texts)) / np.log2(np.maximum(2, n))
    return out


@lru_cache(1)
def _reader() -> Reader:
    return Reader()


def _language(language: str) -> Column:
    """The language lower-cased and trimmed; null, empty and ``und`` are ''."""
    lang = F.lower(F.trim(F.col(language)))
    return F.when(lang.isNull() | lang.isin("", "und", "unknown"), F.lit("")).otherwise(lang)


def _strings(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.view(pa.binary()).to_pylist()]


def function_words(df: DataFrame, text: str, language: str) -> DataFrame:
    """(language, words ARRAY<STRING>): function words of the languages that the fixed lists don't reach.

    A word of up to ``SHORT`` letters counts if at least ``SPREAD`` of the
    language's pages have it and too few listed function words for a
    sentence; of these the ``MOST_WORDS`` most frequent. Pages that the
    lists reach count in the total only, so a language of theirs gets no
    more words. ``SPREAD_PAGES`` pages without any are counted along: a
    language needs ten pages for its first words.
    """
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        reader = _reader()

        def counted() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], schema=arrow)
            seen.clear()
            return rows

        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), _strings(batch.column(1))):
                codes = reader.read(t) if t else []
                if codes:
                    seen[lang, ""] += 1  # "" is no word: the number of pages
                    kinds = [c & 15 for c in codes]
                    n_function, n_words = kinds.count(_FUNCTION), kinds.count(_WORD)
                    if n_function < FUNCTION_RATE * (n_function + n_words):
                        seen.update((lang, w) for n in {c >> _WORD_AT for c in codes if c & 15 == _WORD} if n and len(w := reader.names[n - 1]) <= SHORT)
                reader.forget()
            if len(seen) > _KEPT:
                yield counted()
        yield counted()

    n = df.select(_language(language).alias("_lang"), F.col(text).alias("_text")).mapInArrow(run, schema).groupBy("language", "word").agg(F.sum("n").alias("n"))
    n = n.where((F.col("word") == "") | (F.col("n") >= SPREAD * SPREAD_PAGES))
    both = n.withColumn("total", F.max(F.when(F.col("word") == "", F.col("n"))).over(Window.partitionBy("language")))
    found = both.where((F.col("word") != "") & (F.col("n") >= SPREAD * (F.col("total") + SPREAD_PAGES)))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= MOST_WORDS).groupBy("language").agg(F.collect_list("word").alias("words"))


def _unreached(pages: DataFrame) -> DataFrame:
    """(language) of the languages that may have function words of their own: so many pages lack those of a sentence that a word on all of these would count."""
    few = F.count_if(F.col("features")[KEYS.index("function_words")] < FUNCTION_RATE)
    return pages.where("n_tokens > 0").groupBy("language").agg(F.count(F.lit(1)).alias("n"), few.alias("few")).where(F.col("few") >= SPREAD * (F.col("n") + SPREAD_PAGES)).select("language")


def page_features(df: DataFrame, key: str, text: str, language: str, words: DataFrame | None = None) -> DataFrame:
    """(key, language, features ARRAY<DOUBLE>, recurring, n_tokens, n_characters) of every page.

    ``recurring`` is the share of keywords that come back on the page;
    ``n_characters`` are those of the text as it is. With ``words``
    (language, words) only the pages of these languages come out, their
    words counted as function words.
    """
    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("language", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType(), False)), T.StructField("recurring", T.DoubleType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_characters", T.LongType())])
    arrow, listed = to_arrow_schema(schema), words is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[str]] = {}
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):  # bounds the arrays of a step
                texts, more = _strings(part.column(2)), None
                if listed:
                    languages = part.column(1).to_pylist()
                    for i, lang in enumerate(languages):
                        if lang not in sets:
                            sets[lang] = frozenset(part.column(3)[i].as_py())
                    more = [sets[lang] for lang in languages]
                long = pa.array([len(t.strip()) if t else 0 for t in texts], pa.int64())
                x = features(texts, _reader(), more, True)
                width = len(KEYS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x[:, :width].ravel()), type=arrow.field(2).type)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), part.column(1).cast(arrow.field(1).type), lists, pa.array(x[:, -2]), pa.array(x[:, -1].astype(np.int32)), long], schema=arrow)

    rows = df.select(key, _language(language).alias("_lang"), F.col(text).alias("_text"))
    if listed:
        rows = rows.join(words.select(F.col("language").alias("_lang"), F.col("words").alias("_words")), "_lang").select(key, "_lang", "_text", "_words")
    return rows.mapInArrow(run, schema)


def _features_of_all(df: DataFrame, key: str, text: str, language: str, stage: Stage) -> DataFrame:
    """``page_features``, read again with their words for the languages that turn out to have function words of their own.

    Only pages of languages in which too many pages lack function words are
    read for words; in all others no word can be on enough of them.
    """
    pages = stage.write(page_features(df, key, text, language), "features")
    unreached = stage.write(_unreached(pages), "unreached")
    if unreached.isEmpty():
        return pages
    asked = df.select(key, text, _language(language).alias("_lang")).join(small(unreached, 10_000), F.col("_lang") == F.col("language"), "left_semi")
    words = small(stage.write(function_words(asked, text, "_lang"), "words"), 10_000)
    again = stage.write(page_features(asked, key, text, "_lang", words), "again")
    return pages.join(words.select("language"), "language", "left_anti").unionByName(again)


def _known_keywords(pages: DataFrame) -> DataFrame:
    """``features`` with the keywords of languages without known function words cut to those that come back.

    A language is known by the share of its pages with the function words
    of a sentence, wholly so from a half on; ``UNKNOWN_PAGES`` pages without
    are counted along. In between both shares are mixed.
    """
    enough = pages.where("n_tokens > 0")
    share = F.count_if(F.col("features")[KEYS.index("function_words")] >= FUNCTION_RATE) / (F.count(F.lit(1)) + UNKNOWN_PAGES)
    known = small(enough.groupBy("language").agg(F.least(F.lit(1.0), 2 * share).alias("_known")), 100_000)
    rows = pages.join(known, "language", "left").withColumn("_known", F.coalesce("_known", F.lit(0.0)))
    keywords = F.col("_known") * F.col("features")[0] + (1 - F.col("_known")) * F.col("recurring")
    return rows.withColumn("features", F.concat(F.array(keywords), F.slice("features", 2, len(KEYS) - 1))).drop("_known", "recurring")


#: Pages of all languages that count along with those of each language.
PRIOR_PAGES = 100


def _dot(n: int, term) -> Column:
    return sum((term(i) for i in range(1, n)), term(0))


def _statistics(pages: DataFrame, stage: Stage) -> tuple[DataFrame, list[float], list[float]]:
    """(language, centre, precision): robust centre and inverse scatter matrix of each language, and those of all pages.

    Centre and scatter of a language's closest half are mixed with those of
    all pages (under ''), which weigh as much as ``PRIOR_PAGES`` pages, so a
    language moves from the statistics of all pages to its own with the
    number of its pages, by the same rule at every size of the table.
    """
    k = len(KEYS)
    f = [F.col("features")[i] for i in range(k)]
    both = pages.select(F.explode(F.array_distinct(F.array("language", F.lit("")))).alias("language"), "features")
    middle = both.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.percentile_approx(x, F.lit(0.5), F.lit(1000)) for x in f]).alias("median"))
    middle = small(stage.write(middle, "medians"), 10_000)
    near = both.join(middle, "language").withColumn("d", _dot(k, lambda i: F.pow((f[i] - F.col("median")[i]) / float(FLOORS[i]), 2)))
    half = small(near.groupBy("language").agg(F.percentile_approx("d", F.lit(0.5), F.lit(1000)).alias("half")), 10_000)
    moments = [F.avg(x) for x in f] + [F.avg(f[i] * f[j]) for i in range(k) for j in range(k)]
    found = stage.write(near.join(half, "language").where("d <= half").groupBy("language").agg(F.first("n").alias("n"), F.array(*moments).alias("moments")), "moments")
    pooled = found.where("language = ''").first()
    prior = np.array(pooled["moments"] if pooled else [0.0] * (k + k * k))

    def measures(n: float, own: np.ndarray) -> tuple[list[float], list[float]]:
        weight = n / (n + PRIOR_PAGES)
        within = lambda m: m[k:].reshape(k, k) - np.outer(m[:k], m[:k])
        centre = weight * own[:k] + (1 - weight) * prior[:k]
        # the closest half of a normal sample in 7 dimensions has about 0.42 of its scatter
        scatter = (weight * within(own) + (1 - weight) * within(prior)) / 0.42 + np.diag(FLOORS**2)
        return centre.tolist(), np.linalg.inv(scatter).ravel().tolist()

    schema = "language string, centre array<double>, precision array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["language"], *measures(r["n"], np.array(r["moments"]))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (1, 2))], names=["language", "centre", "precision"])

    return found.mapInArrow(run, schema), *measures(0, prior)


def _to_poles(x: list[Column], c: list[Column], entropy: Column) -> tuple[list[Column], list[Column]]:
    """Spam pole and data pole of a page, as deviations from the centre ``c``; ``x`` is the page's own deviation.

    Of keywords only those beyond the centre count, so prose of a language
    whose sentences aren't told from keywords well has no way to go. The
    spam pole has no function words and the page's own entropy where that
    is below the centre's.
    """
    spam = [F.greatest(x[i], F.lit(0.0)) + (KEYWORD_PRIOR if i == 0 else 0.0) for i in range(len(SPAM_KEYS))]
    total = sum(spam[1:], spam[0])
    pole = [s / total * (1 - (c[0] if i == 0 else 0.0)) for i, s in enumerate(spam)]
    return [*pole, -c[4], F.least(entropy, F.lit(0.0)), -c[6]], [*[-c[i] for i in range(4)], -c[4], entropy, 1 - c[6]]


def spam_pages(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, distance, to_spam, to_data, spam_share, is_spam) of every page.

    ``distance`` is the squared robust Mahalanobis distance from the centre
    of the page's language, ``to_spam`` and ``to_data`` those from the poles
    of spam and of data; ``spam_share`` is how much of the way from the
    centre to the spam pole the page has covered in that metric. Every page
    is measured as if ``PRIOR_CHARACTERS`` characters and ``PRIOR_TOKENS``
    tokens of its language's ordinary prose stood beside it, so a note of a
    few words or a single link lies near the centre and longer pages further
    out, without a step at any size. Null, empty and blank texts are never
    spam. One row per input row, keys as they are; texts are read whole; an
    empty table gives no rows; other columns are ignored. Statistics cover
    all pages with a token; the features are written once to the shared
    folder.
    """
    stage = Stage(df.sparkSession, "spam")
    pages = _known_keywords(_features_of_all(df, key, text, language, stage))
    known, centre, precision = _statistics(pages.where("n_tokens > 0"), stage)
    k = len(KEYS)
    fixed = lambda v: F.array(*[F.lit(x) for x in v])
    rows = pages.join(small(stage.write(known, "known"), 10_000), "language", "left")
    n, m = F.col("n_tokens"), F.col("n_characters")
    evidence = F.least(n / (n + PRIOR_TOKENS), m / (m + PRIOR_CHARACTERS))
    rows = rows.select(key, "features", "n_tokens", evidence.alias("e"), F.coalesce("centre", fixed(centre)).alias("c"), F.coalesce("precision", fixed(precision)).alias("p"))
    rows = rows.withColumn("full", F.zip_with("features", "c", lambda a, b: a - b)).withColumn("x", F.transform("full", lambda v: v * F.col("e")))
    full, c = ([F.col(name)[i] for i in range(k)] for name in ("full", "c"))
    spam, data = _to_poles(full, c, full[5])
    rows = rows.select(key, "n_tokens", "x", "p", F.array(*spam).alias("v"), F.array(*data).alias("w"))

    def product(a: str, b: str) -> Column:
        return _dot(k, lambda i: F.col(a)[i] * _dot(k, lambda j: F.col("p")[i * k + j] * F.col(b)[j]))

    rows = rows.select(key, "n_tokens", product("x", "x").alias("distance"), product("x", "v").alias("_xv"), product("v", "v").alias("_vv"), product("x", "w").alias("_xw"), product("w", "w").alias("_ww"))
    # squared distances from the poles by the law of cosines
    rows = rows.withColumns({"to_spam": F.col("distance") - 2 * F.col("_xv") + F.col("_vv"), "to_data": F.col("distance") - 2 * F.col("_xw") + F.col("_ww"), "spam_share": F.col("_xv") / F.col("_vv")})
    nearest = (F.col("to_spam") <= F.col("distance")) & (F.col("to_spam") < F.col("to_data"))
    is_spam = (F.col("n_tokens") > 0) & (F.col("distance") > DISTANCE_SQUARED) & nearest
    return rows.select(key, "distance", "to_spam", "to_data", "spam_share", F.coalesce(is_spam, F.lit(False)).alias("is_spam"))
