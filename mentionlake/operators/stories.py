"""Assigning articles to stories, article by article in the order of time.

An article joins, of the stories that were updated in the last days and share a target with it, the one whose title or summary is most similar; strictly more similar than all that come before it by
temperature and time of update. If none reaches the threshold, it founds a story. Each article changes what the next one meets: a story's targets, temperature and
time; so the rule is a scan with state, not a join.

The scan is keyed: articles that share no target, directly or through others, never meet, and neither do those with a gap of over the days between them. The targets are configuration, so their components are a small
table. Each (component, stretch without gap) is one ordered scan, in which rows stream by and the state is the stories of the last days. A new article looks up stories with its own words, which
nothing can surpass; or else, by an inverted index of words and by pairs of letters, the few that can pass. Bounds rule out most of these before blocks are matched.

Of many articles, each such scan is parted further by texts (`parted`): an article and a story that have no word of their titles or summaries in common meet only if their titles are nearly equal, so texts that are linked by neither,
directly or through others, are scans of their own. Near titles are found by pieces of which one must be in both.
"""

from __future__ import annotations

from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake.functions import text as T
from mentionlake.functions.similarity import WEAK, Pairs, ratio_above, shared_pairs
from mentionlake.functions.text import STOP_WORDS
from mentionlake.sources.settle import settled

THRESHOLD, DAYS = 0.5, 7
#: Under two shared words titles must reach GATE; a summary's similarity counts SUMMARY times.
GATE, SUMMARY = 0.45, 0.65
NEW_TITLE = "Nova historia"
DAY = 86_400_000_000  # microseconds
#: Articles and stories from which on scans are parted by texts; without it if a word is in more than one of HUB texts, if titles have more than PIECES pieces or a piece more than MATES titles on average, or links more than ROUNDS steps.
LARGE, HUB, PIECES, MATES, ROUNDS = 500_000, 64, 400, 200, 20
#: No longer titles and no lower ratio are sought by pieces.
LONGEST, LEAST_RATIO = 1000, 0.85
STATE = "id long, title string, summary string, temperature double, updated_at timestamp, target_keys array<string>, n_articles long, sources array<string>"
EDGES = "article_id long, story_id long, score double"


def temperature(articles: int, sources: int) -> float:
    return max(0.0, min(100.0, 22.0 + 9.0 * articles + 6.0 * sources))


def warmth(articles: Column, sources: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(22.0) + articles * 9 + sources * 6))


def words_of(text: str) -> frozenset[str]:
    return frozenset(w for w in text.split() if len(w) >= 4 and w not in STOP_WORDS)


@lru_cache(10_000)
def known_words(text: str) -> frozenset[str]:
    return words_of(text)


@lru_cache(10_000)
def pairs_of(text: str) -> Pairs:
    return Pairs.of(text)


def similar(a: str, b: str, words_a: frozenset, words_b: frozenset, least: float) -> float:
    """The similarity of two normalised texts; 0 if it is surely under `least`."""
    if not a or not b:
        return 0.0
    shared = len(words_a & words_b)
    jaccard = shared / len(words_a | words_b) if words_a and words_b else 0.0
    weight = 1.0 if shared >= 2 else WEAK
    ratio = None
    if max(least, jaccard) <= weight and possible(a, b, max(least, jaccard) / weight):
        ratio = ratio_above(a, b, max(least, jaccard) / weight)
    return max(jaccard, weight * (ratio or 0.0))


def possible(a: str, b: str, least: float) -> bool:
    """Whether the ratio of blocks may reach `least`, by lengths and pairs of letters."""
    total, shorter = len(a) + len(b), min(len(a), len(b))
    if 2 * shorter < least * total - 1e-9:
        return False
    needed = shared_pairs(total, least)
    return needed <= 0 or pairs_of(a).most_shared(pairs_of(b)) >= needed


@dataclass
class Story:
    id: int
    title: str  # normalised, without a site's name
    words: frozenset  # of the title as it is
    summary: str
    targets: set
    updated: int
    articles: int = 0
    sources: set = field(default_factory=set)
    temperature: float = 0.0
    slot: int = -1

    def __post_init__(self):
        self.title_words, self.summary_words = known_words(self.title), known_words(self.summary)


class Profiles:
    """Pairs of letters in the titles of stories as bits, and how often each letter (by its number modulo 64) occurs: bounds on what any matching of blocks finds, for all stories at once."""

    def __init__(self):
        self.counts = np.zeros((64, 64), np.uint16)
        self.bits, self.lengths, self.ids, self.free = np.zeros((Pairs.WORDS, 64), np.uint64), np.zeros(64, np.int64), np.zeros(64, np.int64), list(range(63, -1, -1))

    @staticmethod
    def of(title: str) -> np.ndarray:
        return np.bincount([ord(c) % 64 for c in title], minlength=64).astype(np.uint16) if title else np.zeros(64, np.uint16)

    def add(self, title: str, story: int) -> int:
        if not self.free:
            n = len(self.ids)
            self.bits = np.concatenate((self.bits, np.zeros_like(self.bits)), axis=1)
            self.counts, self.lengths, self.ids = (np.concatenate((x, np.zeros_like(x))) for x in (self.counts, self.lengths, self.ids))
            self.free = list(range(2 * n - 1, n - 1, -1))
        slot = self.free.pop()
        self.bits[:, slot], self.counts[slot], self.lengths[slot], self.ids[slot] = pairs_of(title).words(), self.of(title), len(title), story
        return slot

    def remove(self, slot: int) -> None:
        self.lengths[slot] = 0
        self.free.append(slot)

    def near(self, title: str, least: float) -> list[int]:
        """Stories whose titles may have that ratio with this one."""
        if not title or len(self.free) == len(self.ids):
            return []
        own = pairs_of(title)
        shortest = len(title) * least / (2 - least)
        if (needed := shared_pairs(len(title) + shortest, least) - own.lost) > 0:
            common = np.zeros(len(self.ids), np.uint16)
            for row, word in zip(self.bits, own.words(), strict=True):
                if word:
                    common += np.bitwise_count(row & word)
            slots = np.flatnonzero(common >= needed)
            slots = slots[common[slots] >= shared_pairs(self.lengths[slots] + len(title), least) - own.lost]
        else:
            slots = np.flatnonzero(self.lengths)
        lengths = self.lengths[slots]
        slots = slots[(lengths > 0) & (np.minimum(lengths, len(title)) >= least * (lengths + len(title)) / 2 - 1e-9)]
        if not len(slots):
            return []
        common = np.minimum(self.counts[slots], self.of(title)).sum(axis=1)
        return self.ids[slots[common >= least * (self.lengths[slots] + len(title)) / 2 - 1e-9]].tolist()


class Recent:
    """The stories of the last days, oldest update first."""

    def __init__(self, days: int):
        self.stories: OrderedDict[int, Story] = OrderedDict()
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.by_title_word: dict[str, set[int]] = defaultdict(set)
        self.by_title_words: dict[frozenset, set[int]] = defaultdict(set)
        self.letters, self.span = Profiles(), days * DAY
        self.unlettered: dict[int, Story] = {}  # most stories meet articles of the same words only, and need no letters

    def put(self, story: Story) -> None:
        self.stories[story.id] = self.unlettered[story.id] = story
        for index, words in self._indexed(story):
            for w in words:
                index[w].add(story.id)

    def _indexed(self, story: Story) -> tuple:
        return (self.by_word, story.words), (self.by_title_word, story.title_words), (self.by_title_words, [story.title_words])

    def forget(self, before: int) -> None:
        while self.stories and (story := next(iter(self.stories.values()))).updated < before:
            self.stories.popitem(last=False)
            if self.unlettered.pop(story.id, None) is None:
                self.letters.remove(story.slot)
            for index, words in self._indexed(story):
                for w in words:
                    index[w].discard(story.id)
                    if not index[w]:
                        del index[w]

    def candidates(self, title: str, words: frozenset, title_words: frozenset) -> list[int]:
        """All stories that can pass the gate: two shared words, or a title similarity of GATE, by words or by letters. Those with the most words in common come first, as they shorten what follows."""
        common = Counter(s for w in words for s in self.by_word.get(w, ()))
        found = {s: n for s, n in common.items() if n >= 2}
        for s, n in Counter(s for w in title_words for s in self.by_title_word.get(w, ())).items():
            if n >= 2 or n >= GATE * len(title_words | self.stories[s].title_words) - 1e-9:
                found[s] = max(found.get(s, 0), n)
        for story in self.unlettered.values():
            story.slot = self.letters.add(story.title, story.id)
        self.unlettered.clear()
        for s in self.letters.near(title, GATE / WEAK):
            found.setdefault(s, 0)
        return sorted(found, key=found.get, reverse=True)

    def open_to(self, story: Story, a: dict) -> bool:
        return story.updated >= a["at"] - self.span and not story.targets.isdisjoint(a["target_keys"])

    def choose(self, a: dict, threshold: float) -> tuple[Story | None, float]:
        title_words = known_words(a["plain"])
        if title_words and threshold <= 1.0:  # titles of the same words have a similarity of 1, all others less
            same = [s for s in map(self.stories.get, self.by_title_words.get(title_words, ())) if self.open_to(s, a)]
            if same:
                return max(same, key=lambda s: (s.temperature, s.updated, -s.id)), 1.0
        words, summary_words = frozenset(a["words"]), known_words(a["brief"])
        best, best_key = None, (threshold, -1.0, -1, 0)
        for s in self.candidates(a["plain"], words, title_words):
            story = self.stories[s]
            if not self.open_to(story, a):
                continue
            weak = len(words & story.words) < 2
            by_summary = best_key[0] <= SUMMARY and a["brief"] and story.summary and possible(a["brief"], story.summary, best_key[0] / SUMMARY)
            by_summary = by_summary or (best_key[0] <= SUMMARY and not summary_words.isdisjoint(story.summary_words))
            of_title = similar(a["plain"], story.title, title_words, story.title_words, min(GATE, best_key[0]) if weak and by_summary else best_key[0])
            if weak and of_title < GATE:
                continue
            of_summary = similar(a["brief"], story.summary, summary_words, story.summary_words, best_key[0] / SUMMARY) if by_summary else 0.0
            key = (max(of_title, SUMMARY * of_summary), story.temperature, story.updated, -story.id)
            if key > best_key:
                best, best_key = story, key
        return best, best_key[0]

    def place(self, a: dict, threshold: float) -> tuple[int, float | None]:
        """The story of an article, which the article has joined or founded, and the score if it has joined."""
        self.forget(a["at"] - self.span)
        story, score = self.choose(a, threshold)
        if story is None:
            title = a["story_plain"] if a["story_plain"] is not None else a["plain"]
            summary = a["story_brief"] if a["story_brief"] is not None else a["brief"]
            story, score = Story(a["id"], title, frozenset(a["story_words"] if a["story_words"] is not None else a["words"]), summary, set(), a["at"]), None
            self.put(story)
        story.articles += 1
        story.sources.add(a["source_name"])
        story.targets.update(a["target_keys"])
        story.temperature = temperature(story.articles, len(story.sources - {None}))
        story.updated = max(story.updated, a["at"])
        self.stories.move_to_end(story.id)
        return story.id, score


def _values(column: pa.Array) -> list:
    """What to_pylist gives, by way of numpy, which takes a fifth of the time."""
    kind = column.type
    if pa.types.is_list(kind):
        values, at = _values(column.values), column.offsets.to_pylist()
        lists = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return lists if not column.null_count else [x if valid else None for x, valid in zip(lists, column.is_valid().to_pylist(), strict=True)]
    if pa.types.is_string(kind) or (pa.types.is_primitive(kind) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _scan(days: int, threshold: float):
    """Rows come by key, stored stories before articles, then by time and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, recent = None, Recent(days)
        for batch in batches:
            out: list[tuple] = []
            for a in (dict(zip(batch.schema.names, row, strict=True)) for row in zip(*map(_values, batch.columns), strict=True)):
                if a["brief"] is None:
                    a["brief"] = a["plain"]
                if a["key"] != key:
                    key, recent = a["key"], Recent(days)
                if a["stored"]:
                    recent.put(Story(a["id"], a["plain"], frozenset(a["words"]), a["brief"], set(a["target_keys"]), a["at"], a["n_articles"], set(a["sources"]), a["temperature"]))
                else:
                    out.append((a["id"], *recent.place(a, threshold)))
            ids, stories, scores = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stories, pa.int64()), pa.array(scores, pa.float64())], names=["article_id", "story_id", "score"])

    return run


def components(sets: DataFrame) -> DataFrame:
    """(target, component) of sets (target_keys): targets that occur together, directly or through others, have the same least target. A round a step of the longest chain; the targets are few."""
    members = settled(sets.select(F.array_sort(F.array_distinct("target_keys")).alias("s")).where(F.size("s") > 0).distinct().select(F.xxhash64("s").alias("set"), F.explode("s").alias("target")))
    return _least(members, "target")


def _least(members: DataFrame, what: str, rounds: int | None = None) -> DataFrame | None:
    """(what, component) of members (set, what), a settled table; None if the longest chain has more steps than rounds."""
    labels = settled(members.select(what, F.col(what).alias("component")).distinct())
    while rounds is None or rounds > 0:
        least = members.join(labels, what).groupBy("set").agg(F.min("component").alias("least"))
        lower = members.join(least, "set").groupBy(what).agg(F.min("least").alias("lower"))
        moved = settled(labels.join(lower, what).select(what, F.col("lower").alias("component"), (F.col("lower") < F.col("component")).alias("moved")))
        if moved.where("moved").isEmpty():
            return labels
        labels, rounds = moved.select(what, "component"), rounds and rounds - 1
    return None


def parted(keyed: DataFrame, threshold: float, n: int) -> DataFrame:
    """The rows of the scan, with keys that part texts of which none can join a story of the other, by the rules of Recent.choose; with their keys as they are, if that would part little or take long.

    Without a word in common (of titles or of summaries) two texts have no shared words and no Jaccard similarity, and SUMMARY * WEAK is under the threshold, so only a ratio of titles of threshold / WEAK is left.
    What is linked needlessly, as by equal hashes, is only scanned together. n: the rows.
    """
    ratio = threshold / WEAK
    if SUMMARY * WEAK >= threshold or ratio < LEAST_RATIO:
        return keyed
    titles, own = ["key", "plain", "words", "story_plain", "story_words"], ["brief", "story_brief"]
    # words that many titles have show without making summaries
    common = keyed.select(F.explode(_linking(["words"], [])).alias("word")).groupBy("word").count().agg(F.max("count")).first()[0]
    if (common or 0) * HUB > n:
        return keyed
    keyed = settled(keyed)
    node = F.xxhash64(*titles, *own)
    found = keyed.select(*titles, *own).distinct()
    names = F.transform(F.array_compact(F.array("plain", "story_plain")), lambda t: F.xxhash64("key", t))
    texts = settled(found.select(node.alias("node"), "key", "plain", "story_plain", F.array_union(_linking(["words", "story_words"], ["plain", "story_plain", *own]), names).alias("links")))
    links = texts.select("node", F.explode("links").alias("set"))
    shared = settled(links.groupBy("set").count().where("count > 1"))
    if (most := shared.agg(F.max("count")).first()[0]) and most * HUB > texts.count():
        return keyed
    pairs = _near_titles(texts, ratio)
    if pairs is None:
        return keyed
    pairs = settled(pairs.select(F.explode(F.array("x", "y")).alias("set"), F.xxhash64("x", "y").alias("pair")).distinct())
    members = settled(links.join(shared, "set", "left_semi").unionByName(links.join(pairs, "set").select("node", F.col("pair").alias("set"))).distinct())
    labels = _least(members, "node", ROUNDS)
    if labels is None:
        return keyed
    rows = keyed.withColumn("node", node).join(labels, "node", "left")
    return rows.withColumn("key", F.concat_ws("\n", "key", F.coalesce("component", "node").cast("string"))).select(*keyed.columns)


def _linking(arrays: list[str], texts: list[str]) -> Column:
    """Hashes, by key, of the words in arrays and texts. Words of texts are split as words_of does."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    none = F.array().cast("array<string>")
    split = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)[\s\x1C-\x1F]+"), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    words = F.concat(*(F.coalesce(a, none) for a in arrays), *map(split, texts))
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64("key", w))


def errors(a: int, b: int, ratio: float) -> int:
    """How many letters two texts of a and b letters may leave unmatched at that ratio of blocks."""
    return int((1 - ratio) * (a + b) + 1e-6)


def cuts(a: int, ratio: float) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text of a letters: one more than letters that it and a text as long or longer may leave unmatched."""
    n = errors(a, int(a * (2 - ratio) / ratio + 1e-6), ratio) + 1
    ends = [k * a // n for k in range(n + 1)]
    return [(x, y - x) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def probes(a: int, b: int, ratio: float) -> list[tuple[int, int, int]]:
    """(piece, start, length): where a piece of a text of a letters may stand in a text of b >= a letters.

    Each unmatched letter belongs to one piece; the first piece at which pieces outnumber letters so far has none itself and one before it for each piece before it, so it is in both texts, shifted by what those letters can shift it.
    """
    most, out = errors(a, b, ratio), []
    for k, (start, length) in enumerate(cuts(a, ratio)):
        out += [(k, start + s, length) for s in range(-k, k + 1, 2) if k + abs(b - a - s) <= most and 0 <= start + s <= b - length]
    return out


def _pieces(lengths: list[int], ratio: float, other: bool):
    """Rows (h, t, text): a row for each piece of a text, or, for texts as the longer ones of pairs, for each place where a piece of a text of one of the lengths may be; with a sketch of how often letters occur."""

    def places(n: int) -> list[tuple[int, int, int, int]]:
        if not other:
            return [(n, k, *cut) for k, cut in enumerate(cuts(n, ratio))]
        return [(a, *probe) for a in lengths if a <= n and a * (2 - ratio) >= n * ratio - 1e-6 for probe in probes(a, n, ratio)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for n in np.unique(size).tolist():
                at, all_rows = places(n), np.flatnonzero(size == n)
                step = max(1, 1_000_000 // max(n, len(at), 1))
                for rows in (all_rows[i : i + step] for i in range(0, len(all_rows) if at else 0, step)):
                    some = batch.take(pa.array(rows))
                    letters = np.frombuffer("".join(some.column(2).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n).T.astype(np.uint64)
                    sketch = np.zeros(len(rows), np.uint64)
                    bucket = (letters + np.uint64(9) * (letters >> np.uint64(6) & np.uint64(1))) % np.uint64(16)
                    for k in range(16):
                        sketch |= np.minimum((bucket == k).sum(0), 15).astype(np.uint64) << np.uint64(4 * k)
                    h, t = some.column(0).to_numpy().view(np.uint64), some.column(1).to_numpy()
                    piece = np.empty((len(at), len(rows)), np.uint64)
                    for row, (a, k, start, length) in zip(piece, at, strict=True):
                        row[:] = h + np.uint64((a * LONGEST + k) * 0x9E3779B97F4A7C15 % 2**64)
                        for letter in letters[start : start + length]:
                            row ^= row >> np.uint64(29)
                            row *= np.uint64(0xBF58476D1CE4E5B9)
                            row += letter
                    yield pa.RecordBatch.from_arrays([pa.array(piece.reshape(-1).view(np.int64)), pa.array(np.tile(t, len(at))), pa.array(np.tile(sketch.view(np.int64), len(at))), pa.array(np.full(piece.size, n, np.int32))], names=["piece", "t", "sketch", "n"])

    return run


def _near_titles(texts: DataFrame, ratio: float) -> DataFrame | None:
    """(x, y): hashes of titles under the same key that may have that ratio of blocks; all that have it. None if pieces would make too many pairs."""
    if ratio > 1:
        return texts.sparkSession.createDataFrame([], "x long, y long")
    titles = texts.select("key", F.explode(F.array_compact(F.array("plain", "story_plain"))).alias("text")).where("text <> ''").distinct()
    titles = settled(titles.select(F.xxhash64("key").alias("h"), F.xxhash64("key", "text").alias("t"), "text"))
    if (titles.agg(F.max(F.length("text"))).first()[0] or 0) > LONGEST:
        return None
    sizes = {r[0]: r[1] for r in titles.groupBy(F.length("text")).count().collect()}  # LONGEST rows at most
    near = [[len(probes(a, b, ratio)) for a in sizes if a <= b and a * (2 - ratio) >= b * ratio - 1e-6] for b in sizes]
    if sum(n * (len(cuts(b, ratio)) + sum(p)) for (b, n), p in zip(sizes.items(), near, strict=True)) > PIECES * sum(sizes.values()):
        return None
    rows = "piece long, t long, sketch long, n int"
    x, y = (titles.mapInArrow(_pieces(sorted(sizes), ratio, other), rows) for other in (False, True))
    mates = x.groupBy("piece").count().agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
    if (mates[0] or 0) > MATES * (mates[1] or 0):
        return None
    # what is known of the size of pieces is that of titles, by which they would be broadcast
    met = x.alias("x").hint("merge").join(y.alias("y").hint("merge"), "piece").where("x.n < y.n or x.t < y.t")
    part = lambda side, k: F.call_function("shiftright", F.col(f"{side}.sketch"), F.lit(4 * k)).bitwiseAND(15)
    most = F.floor((1 - ratio) * (F.col("x.n") + F.col("y.n")) + 1e-6)
    unlike = sum((F.abs(part("x", k) - part("y", k)) for k in range(1, 16)), F.abs(part("x", 0) - part("y", 0)))
    few = met.where(unlike <= most).select(F.col("x.t").alias("x"), F.col("y.t").alias("y"), most.cast("int").alias("most")).distinct()
    both = few.join(titles.select(F.col("t").alias("x"), F.col("text").alias("a")), "x").join(titles.select(F.col("t").alias("y"), F.col("text").alias("b")), "y")
    return both.where(F.levenshtein("a", "b") <= F.col("most")).select("x", "y")


def _prepared(rows: DataFrame) -> DataFrame:
    """What the scan compares, made of title and summary, and of what a story would keep of them (null if that is the same); brief is null if it is as plain."""
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    kept, brief = story_title(title), story_summary(title, summary)
    plain = lambda c: T.normalize_text(T.clean_title(c))
    own = {"plain": plain(title), "brief": plain(summary), "words": T.significant_tokens(title)}
    story = {"story_plain": (kept, title, plain(kept)), "story_brief": (brief, summary, plain(brief)), "story_words": (kept, title, T.significant_tokens(kept))}
    own_or_null = own | {"brief": F.when(F.when(summary == title, False).otherwise(own["brief"] != own["plain"]), own["brief"])}
    return rows.select(
        *(F.col(c) for c in rows.columns if c not in ("title", "summary")), *(v.alias(k) for k, v in own_or_null.items()),
        *(F.when(F.when(a == b, False).otherwise(v != w), v).alias(k) for (k, (a, b, v)), w in zip(story.items(), own.values(), strict=True)),
    )


def story_title(title: Column) -> Column:
    return F.coalesce(F.nullif(F.left(title, F.lit(220)), F.lit("")), F.lit(NEW_TITLE))


def story_summary(title: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(F.left(summary, F.lit(800)), F.lit("")), F.left(title, F.lit(220)))


def assign(articles: DataFrame, state: DataFrame | None = None, days: int = DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """(article_id, story_id, score) of articles (id, at, title, summary, source_name, target_keys), given the stories so far (STATE); the score is null where an article founds its story, whose id is the article's.

    An article without targets founds a story of its own that none joins. A null title, summary or list is an empty one; equal times go by id.
    """
    spark = articles.sparkSession
    state = spark.createDataFrame([], STATE) if state is None else state
    keys = F.coalesce("target_keys", F.array().cast("array<string>"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    new = articles.select(F.lit(False).alias("stored"), F.col("id").cast("long"), micros("at").alias("at"), "title", "summary", "source_name", keys.alias("target_keys"), F.lit(0).cast("long").alias("n_articles"), F.array().cast("array<string>").alias("sources"), F.lit(0.0).alias("temperature"))
    old = state.select(F.lit(True).alias("stored"), "id", micros("updated_at").alias("at"), "title", "summary", F.lit(None).cast("string").alias("source_name"), keys.alias("target_keys"), "n_articles", "sources", "temperature")
    rows = _prepared(new.unionByName(old)).withColumn("target", F.get("target_keys", F.lit(0)))
    part = components(new.select("target_keys").unionByName(old.select("target_keys")))
    alone = rows.where("target is null and not stored").select(F.col("id").alias("article_id"), F.col("id").alias("story_id"), F.lit(None).cast("double").alias("score"))
    met = rows.join(part, "target").withColumn("day", F.floor(F.col("at") / DAY))
    met = met.join(settled(_stretches(met.select("component", "day").distinct(), days)), ["component", "day"])  # small: rows stay where they are
    keyed = met.withColumn("key", F.concat_ws("\n", "component", F.col("stretch").cast("string"))).drop("component", "target", "day", "stretch")
    if (n := new.count() + old.count()) >= LARGE:
        keyed = parted(keyed, threshold, n)
    order = ["key", F.desc("stored"), "at", "id"]
    return keyed.repartition("key").sortWithinPartitions(*order).mapInArrow(_scan(days, threshold), EDGES).unionByName(alone)


def _stretches(active: DataFrame, days: int) -> DataFrame:
    """(component, day, stretch): active days, numbered anew after each gap in which all stories are forgotten. A row a component and day."""
    from pyspark.sql import Window

    order = Window.partitionBy("component").orderBy("day")
    gap = F.coalesce(F.col("day") - F.lag("day").over(order) > days, F.lit(False))
    return active.withColumn("cut", gap.cast("int")).withColumn("stretch", F.sum("cut").over(order)).drop("cut")


def stories_after(articles: DataFrame, edges: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The stories that edges touch as they are then: STATE and created_at. What a story had before is in state, for which created_at is taken if it is there."""
    spark = articles.sparkSession
    named = F.named_struct(F.lit("title"), "title", F.lit("summary"), "summary")
    joined = edges.join(articles.withColumn("id", F.col("id").cast("long")), F.col("article_id") == F.col("id"))
    founder = F.col("article_id") == F.col("story_id")
    grown = joined.groupBy("story_id").agg(
        F.max(F.when(founder, named)).alias("founder"), F.min(F.when(founder, F.col("at").cast("timestamp"))).alias("born"), F.max(F.col("at").cast("timestamp")).alias("last"),
        F.count(F.lit(1)).alias("n"), F.collect_set("source_name").alias("from"), F.array_distinct(F.flatten(F.collect_set("target_keys"))).alias("of"),
    )
    old = (spark.createDataFrame([], STATE) if state is None else state).withColumnRenamed("id", "story_id")
    old = old if "created_at" in old.columns else old.withColumn("created_at", F.lit(None).cast("timestamp"))
    both = grown.join(old, "story_id", "left")
    none = F.array().cast("array<string>")
    title, summary = F.coalesce("founder.title", F.lit("")), F.coalesce("founder.summary", F.lit(""))
    n = F.coalesce("n_articles", F.lit(0)) + F.col("n")
    sources = F.array_sort(F.array_union(F.coalesce("sources", none), "from"))
    return both.select(
        F.col("story_id").alias("id"), F.coalesce("title", story_title(title)).alias("title"), F.coalesce(both["summary"], story_summary(title, summary)).alias("summary"), warmth(n, F.size(sources)).alias("temperature"),
        F.greatest("updated_at", "last").alias("updated_at"), F.array_sort(F.array_union(F.coalesce("target_keys", none), "of")).alias("target_keys"), n.alias("n_articles"), sources.alias("sources"), F.coalesce("created_at", "born").alias("created_at"),
    )
