"""Problem 8: pages of repeated keywords, link lists and tags instead of sentences.

A text is a sequence of terms with positions. Two signs mark terms as stuffing:

* *Lists without function words.* Function words recur in any prose after a few terms. A stretch between two of them that holds
  more than ``MAX_GAP`` terms is a list: of nouns, tags, menu entries, products or links. That no function word was seen says
  nothing where none is known: stretches in other scripts are left aside, and so are, in texts with hardly a function word, those
  parts that have the form of sentences (:func:`sentence_like`), as prose in a language without known function words has.
* *Unnaturally regular repetition*, in any language. Within a window of ``WINDOW`` terms, the positional autocorrelation (the share
  of terms equal to the term ``lag`` positions back) reaches ``REGULAR``, so terms recur at a constant gap; like sentences in a
  row, which hold more function words than ``PROSE``, are left aside. Lags are all up to ``MAX_LAG`` and beyond them those of the
  terms' own recurrence gaps, whatever their length. Where ``RECURRING`` of a window's terms recur within ``WINDOW`` terms, the gaps
  may be uneven. These two need windows with fewer function words than ``SPARSE`` and no such numbers as readings hold. A text
  of fewer terms is one window.

Lines of measurements, files, colours and the like are records, not stuffing: their numbers stand in fields, with units, separators
or names. A document is a case if more than half of its characters lie in marked terms. Texts are read whole; each is judged by
itself, so nothing is shuffled and no corpus statistic, cap or sample is involved. Many texts are judged at once, as one
sequence whose windows, gaps and lags end where a text ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import spread, table

#: Function words of English, German, French and Spanish without accents, and of Chinese as characters.
FUNCTION_WORDS = frozenset(
    """
    the a an of in on to and or is are was were be been it its this that these those with for from by at as but if not no than
    then so when while although because unless though after since once would will can could should may might must do does did
    didn't isn't has have had he she they we you i our their his her my your what which who how why where there yet both between
    into beside before again about only put under over behind across around along off too didn t isn
    der die das den dem des ein eine einen einem einer und oder ist sind war wird wurde wurden nicht mit von zu im auf bei fur aus
    wie obwohl weil wenn es sie er wir ich niemand hat haben sobald uber neben unter zwischen hinter am so warum eins
    le la les l un une du de d et ou est sont ete au aux en dans sur par pour que qui ne pas bien parce quand des si cette ce
    ces elle il nous se y pourquoi personne
    el los las uno una unos o son fue con para lo del al como cuando porque aunque sin tan esta nadie entre cuanto qu'on s'est
    """.split()  # noqa: SIM905
)
FUNCTION_CHARS = frozenset("的了在是把被和与不没么从到为因吗就也都着并这那其很有只对于而张靠看起来虽然去掉之后第级")
ELIDED = ("l'", "d'", "qu'", "s'", "n'", "c'", "j'")

#: Terms between function words beyond which a stretch is a list; a link counts for LINK terms, a Chinese character for HAN.
MAX_GAP, LINK, HAN = 8.0, 3.0, 0.5
#: Terms that are left of such a stretch, from which it is a list, without the ends of the sentences beside it.
MIN_LIST = 4.0
#: Positional autocorrelation: terms in a window, longest lag that is tried whether or not it is a gap, share of equal terms that is unnatural.
WINDOW, MAX_LAG, REGULAR = 30, 12, 0.45
#: Longer lags are the gaps to the MAX_ORDER last occurrences of a term; one that recurs oftener within a period recurs nearby.
MAX_ORDER = 8
#: Share of a window's terms that come again within WINDOW terms, other than function words, that is unnatural.
RECURRING = 0.7
#: Share of function words in a window from which its repetition is that of like sentences.
PROSE = 0.36
#: The same for recurrence at uneven gaps and at longer lags, which sentences on one subject show as well.
SPARSE = 0.2
#: Share of numbers, digests and paths from which a line is a record, if so many of them are FIELDS of one.
RECORD, FIELDS = 0.25, 0.5
#: Share of numbers from which a stretch without function words tells readings.
FIGURES = 0.15
#: Share of a text's words that are function words, below which its language may be none that is known.
UNKNOWN = 0.2
#: Share of a stretch's terms in scripts without known function words, from which it is left aside.
FOREIGN = 0.25
#: What a sentence in an unknown language has: so many terms, most of them lower case after a capital, few of them twice.
SENTENCE, LOWER, DIFFERENT = 5, 0.7, 0.8
#: Share of a document's characters in marked terms from which it is a case.
MOST = 0.5

#: Endings that make a name with a dot a file (unless a path follows) or two sentences without a blank between, not a host.
_FILES = "png jpe?g gif svg webp tiff? bmp pdf txt csv tsv json ya?ml toml xml html? css js ts py ipynb java cpp md rst tex log cfg ini sh sql parquet np[yz] pkl zip gz tar exe docx? xlsx? pptx? mp[34] avi"
_NO_HOST = rf"(?:{_FILES.replace(' ', '|')})(?![\w/])|(?:{'|'.join(sorted(w for w in FUNCTION_WORDS if len(w) > 2 and w.isalpha()))})\b"
#: Labels joined by dots, one with a letter before an ending of letters, and what follows; not a call, an assignment or part of a path.
_HOST = (
    r"(?<![[\w./@\-]--\p{Han}])(?<!=\s?)(?=[\d_.\-]*+\p{L}[[\w\-]--\p{Han}]*+(?:\[\.\]|\.))(?:[[\w\-]--\p{Han}]++(?:\[\.\]|\.))++"
    rf"(?!(?i:{_NO_HOST}))(?:[a-z]{{2,24}}|(?<=[\p{{Lu}}\d](?:\[\.\]|\.))[A-Z]{{2,24}})"
    r"(?![[\w\-]--\p{Han}]|\.\w|\s*[=(]|\[(?!\.))(?::\d+)?(?:[/?\#][^\s<>\"')\]|]*)?"
)
_LINK = (
    r"<a\s[^<>]*>|(?:https?|hxxps?)://[^\s<>\"')\]|]+|www\.[^\s<>\"')\]|]+"
    rf"|{_HOST}"
)
_NUMBER = r"[\w-]+(?:/[\w-]+)+\.\w{2,4}\b|\b(?=\w*\d)[0-9a-f]{12,}\b|\#(?=\w*\d)[0-9a-f]{6}\b|(?<!\p{L})[+-]?\d+(?:[.,:]\d+)*%?"
_WORD = r"(?:\p{Lu}?\p{Ll}+|\p{Lu}+|[\p{Lo}--\p{Han}]+)\d{0,2}(?:['’](?:\p{Ll}+|\p{Lu}+)|-(?:\p{Lu}?\p{Ll}+|\p{Lu}+))*"
KIND = regex.compile(rf"(?P<link>{_LINK})|(?P<num>{_NUMBER})|(?P<han>\p{{Han}})|(?P<word>{_WORD})", regex.V1)
#: Plain lower-case words first, so that most terms cost one look: what follows them tells that no other branch could begin here.
TERMS = regex.compile(rf"(\p{{Ll}}+(?![\w'/.\[:@\-])|{_LINK}|{_NUMBER}|\p{{Han}}|{_WORD})", regex.V1)
#: The same without links, for texts that hold none of what a link needs, and again for those of ASCII characters alone.
PLAIN_TERMS = regex.compile(rf"(\p{{Ll}}+(?![\w'/\-])|{_NUMBER}|\p{{Han}}|{_WORD})", regex.V1)
_ASCII_WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,2}(?:'(?:[a-z]+|[A-Z]+)|-(?:[A-Z]?[a-z]+|[A-Z]+))*"
_ASCII_NUMBER = _NUMBER.replace(r"\p{L}", "[A-Za-z]")
_ASCII_HOST = (
    r"(?<![\w./@\-])(?<!=)(?<!=\s)(?=[\d_.\-]*+[A-Za-z][\w\-]*+(?:\[\.\]|\.))(?:[\w\-]++(?:\[\.\]|\.))++"
    rf"(?!(?i:{_NO_HOST}))(?:[a-z]{{2,24}}|(?:(?<=[A-Z\d]\.)|(?<=[A-Z\d]\[\.\]))[A-Z]{{2,24}})"
    r"(?![\w\-]|\.\w|\s*[=(]|\[(?!\.))(?::\d+)?(?:[/?\#][^\s<>\"')\]|]*)?"
)
ASCII_TERMS = re.compile(rf"([a-z]+(?![\w'/.\[:@\-])|{_LINK.replace(_HOST, _ASCII_HOST)}|{_ASCII_NUMBER}|{_ASCII_WORD})", re.ASCII)
ASCII_PLAIN = re.compile(rf"([a-z]+(?![\w'/\-])|{_ASCII_NUMBER}|{_ASCII_WORD})", re.ASCII)
DOTTED = re.compile(r"\.\]?[A-Za-z]{2}")
#: Marks of offers: an article number, a price, a link in markup.
OFFER = regex.compile(r"\b(?:sku|no|art\.?|ref)\s*\d{4,}|[$€£]\s?\d|\beur\s?\d|<a\s|\]\(|https?:|hxxp|www\.", regex.I)
#: What makes a number the field of a record: its own form (decimals, times, shares, signs, paths, digests, colours), a separator or
#: a bracket beside it, a unit behind or a field's name before it. Model numbers, sizes and years among keywords have none of these.
FORM = regex.compile(r"[.,:%/#]|^[+-]|\p{L}")
BEFORE = re.compile(r"(?:[=:|\t(\[;/<>~±*][ ]?|,|\b(?:vol|nr|pp?|fig|tab|seed|level|step|run|epoch|page|line|row|id)\b\.?[ ])$", re.I)
UNITS = "px ms s sec min h hz khz mhz k kb mb gb tb kib mib gib bytes? bits? mm cm m km kg g mg pt dpi deg fps images? bilder? rows? lines? epochs?"
AFTER = regex.compile(rf"[ ]?(?:[|=%°×;/\]):*]|\t|,(?=\S)|(?:{UNITS.replace(' ', '|')})\b)", regex.I)
MARKS = regex.compile(r"[\p{M}\p{Cf}]+")
CLOSING = regex.compile(r"</\w+\s*>")
#: Digits that stand for letters inside a word.
LEET = str.maketrans("01345", "oieas")
LEETISH = re.compile(r"[01345](?<=[^\W\d_].)[^\W\d_]")
LEET_WORD = re.compile(r"\b(?![0-9a-fA-F]+\b)[^\W\d_]+(?:[01345][^\W\d_]+)+\b")
#: What ends a sentence before white space, and anywhere; what may stand between the mark and the white space.
STOPS, FULL_STOPS, CLOSERS = ".!?", "。！？", "\"')»”"
SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())
#: Terms of Latin letters or Han characters, the scripts of the function words above.
KNOWN_SCRIPT = regex.compile(r"[\p{Latin}\p{Han}]")
#: Between two texts read as one: no term, line, sentence or link goes across.
BORDER = "\n<\n"
#: Characters of text that are judged at once; a longer text is judged by itself.
BLOCK_CHARS = 1_000_000


class Lexicon(dict):
    """Term -> index into arrays of what a term is. A process meets the same terms again and again, so each is judged once.

    It starts afresh when it holds MOST_TERMS, between blocks of texts: a bound on memory that changes no result.
    """

    MOST_TERMS = 300_000
    FIELDS = ("code", "weight", "number", "function", "no", "han", "formed", "foreign", "lower", "capital")

    def __init__(self):
        super().__init__()
        self.lowers: dict[str, int] = {}
        self.arrays = tuple(np.zeros(1024, {"code": np.int64, "weight": float}.get(f, bool)) for f in self.FIELDS)

    def __missing__(self, term: str) -> int:
        m = KIND.fullmatch(term)
        kind, low = m.lastgroup if m else "word", term.lower()
        k = len(self)
        if k == len(self.arrays[0]):
            self.arrays = tuple(np.concatenate([x, np.zeros_like(x)]) for x in self.arrays)
        function = (kind == "han" and low in FUNCTION_CHARS) or (kind == "word" and (low in FUNCTION_WORDS or low.startswith(ELIDED)))
        told = (
            self.lowers.setdefault(low, len(self.lowers)), {"link": LINK, "num": 0.5, "han": HAN, "word": 1.0}[kind], kind == "num", function, low == "no", kind == "han",
            kind == "num" and FORM.search(term) is not None, kind == "word" and not KNOWN_SCRIPT.search(term), kind == "word" and term.islower(), term[0].isupper(),
        )
        for x, v in zip(self.arrays, told, strict=True):
            x[k] = v
        self[term] = k
        return k

    def read(self, terms: list[str]) -> dict[str, np.ndarray]:
        """FIELDS of the terms of a block: code of the lower-case term, weight, and whether it is a number, a function word, ..."""
        if len(self) > self.MOST_TERMS:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, terms), np.int64, len(terms))
        return {f: a[at] for f, a in zip(self.FIELDS, self.arrays, strict=True)}


def in_fields(text: str, at: np.ndarray, terms: list[str], which: np.ndarray) -> np.ndarray:
    """Of the numbers at the indices ``which``: does what is beside it make it the field of a record?"""
    places = at[which].tolist()
    told = [BEFORE.search(text, max(p - 8, 0), p) is not None or AFTER.match(text, p + len(terms[i])) is not None for p, i in zip(places, which.tolist(), strict=True)]
    return np.array(told, bool)


def readable(text: str) -> str:
    """Without accents, marks, closing tags and digits that stand for letters."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("’", "'")
    text = CLOSING.sub(" ", text) if "</" in text else text
    return LEET_WORD.sub(lambda m: m.group().translate(LEET), text) if LEETISH.search(text) else text


def split_terms(text: str) -> list[str]:
    """What lies before the first term, the term, what lies behind it, the next term, ..."""
    plain = not ("://" in text or "www." in text or "<a" in text or DOTTED.search(text))
    if text.isascii():
        return (ASCII_PLAIN if plain else ASCII_TERMS).split(text)
    return (PLAIN_TERMS if plain else TERMS).split(text)


def sentence_like(head: int, end: int, told: dict[str, np.ndarray], mark: bool) -> bool:
    """Has the stretch of terms from ``head`` to ``end`` the form of a sentence: a capital, mostly other lower-case words, an end ``mark``?"""
    n = end - head
    if n < SENTENCE or not mark or not told["capital"][head]:
        return False
    return told["lower"][head + 1 : end].mean() >= LOWER and len(np.unique(told["code"][head:end])) >= DIFFERENT * n


def sentence_ends(text: str, points: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which a sentence begins, in order, and whether a mark ended the one before: line breaks do without."""
    stops = np.flatnonzero(np.isin(points, list(map(ord, STOPS))))
    behind = points[np.minimum(stops + 1, len(points) - 1)]
    closer = np.isin(behind, list(map(ord, CLOSERS)))
    ends = (stops == len(points) - 1) | np.isin(behind, list(map(ord, SPACES)))
    for k in np.flatnonzero(closer).tolist():
        at = int(stops[k]) + 1
        while at < len(text) and text[at] in CLOSERS:
            at += 1
        ends[k] = at == len(text) or text[at] in SPACES
    marks = np.concatenate([stops[ends], np.flatnonzero(np.isin(points, list(map(ord, FULL_STOPS))))])
    places = np.concatenate([marks, breaks])
    order = np.argsort(places, kind="stable")
    return places[order], np.repeat([True, False], [len(marks), len(breaks)])[order]


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _block_shares(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """:func:`stuffing_shares` of readable texts that are judged together."""
    parts = [split_terms(t) for t in texts]
    text, n_docs = BORDER.join(texts), len(texts)
    terms = list(chain.from_iterable(p[1::2] for p in parts))
    held = np.fromiter((len(p) // 2 for p in parts), np.int64, n_docs)
    n = len(terms)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    solid = _sums(points > 32)  # characters that aren't blanks before each place
    to = np.cumsum(np.fromiter(map(len, texts), np.int64, n_docs) + len(BORDER)) - len(BORDER)  # where texts end
    from_ = np.concatenate([[0], to[:-1] + len(BORDER)])
    whole = solid[to] - solid[from_]
    if not n:
        return np.zeros(n_docs)
    doc = np.repeat(np.arange(n_docs), held)
    first = (np.cumsum(held) - held)[doc]  # of each term's text: the first term and the one behind the last
    last = first + held[doc]
    lengths = np.cumsum(np.fromiter(map(len, chain.from_iterable(parts)), np.int64, 2 * n + n_docs))
    at = lengths[2 * np.arange(n) + doc] + len(BORDER) * doc
    ends = to[doc]
    size = solid[np.where(np.arange(n) + 1 < last, np.append(at[1:], 0), ends)] - solid[at]
    told = lexicon.read(terms)
    code, weight, number, function, han = (told[f] for f in ("code", "weight", "number", "function", "han"))
    function[:-1] &= ~(number[1:] & told["no"][:-1] & (doc[1:] == doc[:-1]))  # an article number's mark

    # lines of records
    newline = (points == 10) | (points == 13)
    breaks = np.flatnonzero(newline & ~np.concatenate([[False], newline[:-1]]))
    line = np.searchsorted(breaks, at)
    n_lines = len(breaks) + 1
    in_line, numbers_in = np.bincount(line, minlength=n_lines), np.bincount(line, weights=number, minlength=n_lines)
    field = told["formed"].copy()
    which = np.flatnonzero(number & ~field)
    field[which] = in_fields(text, at, terms, which)
    record_line = (numbers_in >= RECORD * np.maximum(in_line, 1)) & (np.bincount(line, weights=field, minlength=n_lines) >= FIELDS * numbers_in) & (in_line > 0)
    edges = np.concatenate([[0], breaks, [len(text)]])
    for i in np.flatnonzero(record_line).tolist():
        if OFFER.search(text, int(edges[i]), int(edges[i + 1])):
            record_line[i] = False
    record = record_line[line]

    # lists: stretches between function words; those that stand alone in a list don't make it prose
    where = np.flatnonzero(function)
    reach = _sums(weight)
    if len(where):
        gap = np.where(doc[where[1:]] == doc[where[:-1]], reach[where[1:]] - reach[where[:-1] + 1], np.inf)
        where = where[np.minimum(np.append(np.inf, gap), np.append(gap, np.inf)) <= MAX_GAP]
    starts, stops = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)
    begin, behind = np.concatenate([where + 1, starts]), np.repeat([True, False], [len(where), len(starts)])
    order = np.argsort(begin, kind="stable")
    begin, behind = begin[order], behind[order]
    end, before = np.concatenate([where, stops]), np.repeat([True, False], [len(where), len(stops)])
    order = np.argsort(end, kind="stable")
    end, before = end[order], before[order]
    marked = np.zeros(n, bool)
    plain, numbers, foreign = _sums(np.where(record, 0.0, weight)), _sums(number), _sums(np.where(told["foreign"], weight, 0.0))
    # the first term of each sentence: the rest of the sentence a function word stands in isn't part of the list beside it
    places, marks = sentence_ends(text, points, breaks)
    heads, seen = np.unique(np.searchsorted(at, places + 1), return_index=True)
    mark = dict(zip(heads.tolist(), marks[seen].tolist(), strict=True))
    last_mark = text.rstrip()[-1:] in ".!?"
    unknown = np.bincount(doc, weights=function, minlength=n_docs) < UNKNOWN * np.bincount(doc, weights=~number, minlength=n_docs)
    long = plain[end] - plain[begin] > MAX_GAP
    for a, b, fa, fb in zip(begin[long].tolist(), end[long].tolist(), behind[long].tolist(), before[long].tolist(), strict=True):
        inner = heads[np.searchsorted(heads, a) : np.searchsorted(heads, b, side="right")]
        if fa and len(inner) and plain[inner[0]] - plain[a] <= MAX_GAP:
            a = int(inner[0])
        if fb and len(inner) and inner[-1] >= a and plain[b] - plain[inner[-1]] <= MAX_GAP:
            b = int(inner[-1])
        if plain[b] - plain[a] <= MIN_LIST or foreign[b] - foreign[a] >= FOREIGN * (reach[b] - reach[a]):
            continue
        # readings and log heads hold numbers; so do offers, with an article number, a price or a link
        figures = numbers[b] - numbers[a] >= FIGURES * (b - a)
        if figures and OFFER.search(text, int(at[a]), int(at[b]) if fb else int(ends[a])) is None:
            continue
        marked[a:b] = True
        if unknown[doc[a]]:
            cuts = [a, *inner[(inner > a) & (inner < b)].tolist(), b]
            for h, e in zip(cuts[:-1], cuts[1:], strict=True):
                # the whole sentence, of which a function word may have taken the ends
                k = np.searchsorted(heads, h, side="right")
                whole_from, whole_to = (int(heads[k - 1]) if k else 0), (int(heads[k]) if k < len(heads) else n)
                if sentence_like(whole_from, whole_to, told, mark.get(whole_to, last_mark)):
                    marked[h:e] = False

    # regular repetition: windows over term positions, one for a text of fewer terms than a window
    span = np.minimum(WINDOW, last - first)
    open_at = np.flatnonzero(np.arange(n) + span <= last)
    shut_at, span_at = open_at + span[open_at], span[open_at]
    within = lambda flags: (lambda c: c[shut_at] - c[open_at])(_sums(flags))
    least = np.maximum(np.ceil(REGULAR * span - 1e-9).astype(np.int64), 2)
    in_window, figures, fields = within(function), within(number), within(field)
    read = within(np.where(han, function / HAN, function))  # one in a Chinese word of two characters
    sparse = (read <= SPARSE * span_at) & ((figures < FIGURES * span_at) | (fields < FIELDS * figures))
    loose = np.where(span_at >= WINDOW, in_window <= PROSE * span_at, sparse)
    regular = np.zeros(len(open_at), bool)
    for lag in range(1, min(MAX_LAG, n - 1) + 1):
        same = np.zeros(n, bool)
        same[lag:] = (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag])
        regular |= (within(same) >= least[open_at]) & loose
    cover = np.zeros(n + 1, np.int64)
    if sparse.any():
        sparse_at = np.zeros(n, bool)
        sparse_at[open_at] = sparse
        # recurrence at uneven gaps: terms other than function words, numbers and single characters that come again nearby
        order = np.argsort(doc * (int(code.max()) + 1) + code, kind="stable")
        ranked, spots = code[order], doc[order]
        again = np.zeros(n, bool)
        far_lag, far_place = [], []
        some = np.bincount(doc[open_at], weights=sparse, minlength=n_docs) > 0
        for k in range(1, min(MAX_ORDER, n - 1) + 1):
            alike = (ranked[k:] == ranked[:-k]) & (spots[k:] == spots[:-k])
            here, there = order[k:][alike], order[:-k][alike]
            if k == 1:
                near = here - there <= WINDOW
                again[here[near]] = again[there[near]] = True
            # longer lags, those of the gaps that occur
            far = (here - there > MAX_LAG) & some[doc[here]]
            far_lag.append((here - there)[far])
            far_place.append(here[far])
        regular |= (within(again & ~function & ~number & ~han) >= np.maximum(RECURRING * span_at, 3)) & sparse
        lag, place = np.concatenate([*far_lag, np.zeros(0, np.int64)]), np.concatenate([*far_place, np.zeros(0, np.int64)])
        key = first[place] + lag  # a lag is shorter than its text, so it is told from the other texts' lags
        often = np.bincount(key, minlength=n)[key] >= least[place]
        if often.any():
            # a run of equal gaps within a window, and where its terms come from
            lag, place, key = lag[often], place[often], key[often]
            by_lag = np.lexsort((place, key))
            lag, place, key = lag[by_lag], place[by_lag], key[by_lag]
            other = np.minimum(np.arange(len(key)) + least[place] - 1, len(key) - 1)
            a, b = place, place[other]
            run = (key[other] == key) & (other - np.arange(len(key)) == least[place] - 1) & (b - a < span[a])
            run &= sparse_at[np.minimum(a, last[a] - span[a])] & sparse_at[np.maximum(np.where(run, b, a) + 1 - span[a], first[a])]
            for back in (0, lag[run]):
                np.add.at(cover, a[run] - back, 1)
                np.add.at(cover, b[run] + 1 - back, -1)
    np.add.at(cover, open_at[regular], 1)
    np.add.at(cover, shut_at[regular], -1)
    marked |= np.cumsum(cover[:-1]) > 0
    return np.bincount(doc, weights=np.where(marked & ~record, size, 0), minlength=n_docs) / np.maximum(whole, 1)


def stuffing_shares(texts: list[str | None], lexicon: Lexicon | None = None) -> np.ndarray:
    """Of each text the share of its characters (blanks aside) that lie in lists or unnaturally regular repetition; 0 for nothing to read."""
    lexicon = Lexicon() if lexicon is None else lexicon
    out, block, room = np.zeros(len(texts)), [], BLOCK_CHARS
    for i, text in enumerate(texts):
        if text:
            block.append((i, readable(text)))
            room -= len(block[-1][1])
        if block and (room <= 0 or i == len(texts) - 1):
            out[[k for k, _ in block]] = _block_shares([t for _, t in block], lexicon)
            block, room = [], BLOCK_CHARS
    return out


def stuffing_share(text: str | None) -> float:
    return float(stuffing_shares([text])[0])


def stuffing_scores(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, share) of every row of ``docs`` (key, text), repeated ones too. NULL, empty and blank texts have share 0.

    Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            share = stuffing_shares(batch.column(1).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.float64())], [key, "share"])

    rows = spread(docs.select(key, "text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, share double")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing_scores(table(spark, sf_dir, "documents")).where(F.col("share") > MOST).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, share) of all documents."""
    return stuffing_scores(table(spark, sf_dir, "documents")).select("doc_id", F.round("share", 6).alias("share"))
