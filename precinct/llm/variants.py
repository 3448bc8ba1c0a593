"""Spelling variant grouping: words one letter apart, found in a frequency-vector trie.

The letters fall into groups, and a word is the vector of its letter counts by group, the most
used groups first. Level k of the trie branches by the count of group k. One inserted, deleted or replaced letter changes
the vector by a surplus of one at most and a deficit of one at most, so a depth-first search
for a word follows the branch of its own count, and, as long as the budget of one each is not
spent, those of one more and one less. Words of one vector share a search. Words at the leaves
are verified letter by letter, if they share the half before or after the change.

The top of the trie is a Spark shuffle: words go to the node of their first counts, and
searches to the nodes their budget reaches. The depth is the least at which no node has more
than ``NODE_WORDS`` words. Below, each node is a trie of its own in one task. Should a node be
larger at full depth, its words and the searches are cut in blocks, each meeting each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.llm.tables import ship_package, staged

GROUPS = 16
NODE_WORDS = 1 << 15
NODE_SEARCHES = 1 << 18
# Words that stay together in a leaf, where verifying is cheaper than going on.
LEAF = 10
# How much more frequent than a word its form must be.
RATIO = 5


def vector(word: str, order: list[int]) -> tuple[int, ...]:
    """Letter counts by group, in the given order of the groups.

    Letters are grouped by their code points modulo the number of groups.
    """
    codes = [ord(letter) % len(order) for letter in word]
    return tuple(map(codes.count, order))


def vector_column(word: Column, groups: int = GROUPS) -> Column:
    """Letter counts by group, in the order of the groups' numbers."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.ascii(c) % groups)
    each = F.sequence(F.lit(0), F.lit(groups - 1))
    return F.transform(F.array(codes), lambda c: F.transform(each, lambda g: F.size(F.filter(c, lambda k: k == g))))[0]


def one_apart(one: str, other: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if len(one) > len(other):
        one, other = other, one
    if len(other) - len(one) > 1:
        return False
    k = 0
    while k < len(one) and one[k] == other[k]:
        k += 1
    if len(one) == len(other):
        return k < len(one) and one[k + 1 :] == other[k + 1 :]
    return one[k:] == other[k + 1 :]


def half(word: str) -> tuple[str, str]:
    """One edit leaves the letters before it or after it: half of the word at least."""
    h = max(0, len(word) - 1) // 2
    return word[:h], word[len(word) - h :]


def trie(words: list[tuple[tuple[int, ...], str, int]], level: int):
    """Nested branches by count from ``level`` on; a list of (word, n) is a leaf."""
    if len(words) <= LEAF or level == len(words[0][0]):
        return [(word, n) for _, word, n in words]
    branches: dict[int, list] = {}
    for entry in words:
        branches.setdefault(entry[0][level], []).append(entry)
    return {count: trie(part, level + 1) for count, part in branches.items()}


def reached(root, counts: tuple[int, ...], level: int, surplus: int, deficit: int) -> Iterator[list]:
    """The leaves a search reaches, depth first, each by the one way its counts allow."""
    stack = [(root, level, surplus, deficit)]
    while stack:
        node, level, surplus, deficit = stack.pop()
        if isinstance(node, list):
            yield node
            continue
        count = counts[level]
        if count in node:
            stack.append((node[count], level + 1, surplus, deficit))
        if surplus and count + 1 in node:
            stack.append((node[count + 1], level + 1, 0, deficit))
        if deficit and count - 1 in node:
            stack.append((node[count - 1], level + 1, surplus, 0))


_FOUND = "word string, n_near bigint, best_n bigint, best string"


def _searcher(order: list[int], depth: int):
    def run(key: tuple[pa.Scalar, ...], stored: pa.Table, searches: pa.Table) -> pa.Table:
        words, near, most, best = [], [], [], []
        asked: dict[tuple, list[str]] = {}
        if len(stored):
            for word, *budget in zip(*(searches[c].to_pylist() for c in ("word", "surplus", "deficit"))):
                asked.setdefault((vector(word, order), *budget), []).append(word)
            names = stored["word"].to_pylist()
            root = trie([(vector(w, order), w, n) for w, n in zip(names, stored["n"].to_pylist())], depth)
        for (counts, surplus, deficit), alike in asked.items():
            candidates = [pair for leaf in reached(root, counts, depth, surplus, deficit) for pair in leaf]
            for word in alike:
                head, tail = half(word)
                found = [
                    (-n, other)
                    for other, n in candidates
                    if (other.startswith(head) or other.endswith(tail)) and one_apart(word, other)
                ]
                if found:
                    n, other = min(found)
                    words.append(word)
                    near.append(len(found))
                    most.append(-n)
                    best.append(other)
        return pa.table(
            {
                "word": pa.array(words, pa.string()),
                "n_near": pa.array(near, pa.int64()),
                "best_n": pa.array(most, pa.int64()),
                "best": pa.array(best, pa.string()),
            }
        )

    return run


def _order(words: DataFrame, groups: int) -> list[int]:
    """The groups by their letters in all words, most first."""
    counts = words.select(vector_column(F.col("word"), groups).alias("counts"))
    used = counts.agg(*[F.sum(F.get("counts", F.lit(g))).alias(str(g)) for g in range(groups)]).first()
    return sorted(range(groups), key=lambda g: (-(used[g] or 0), g))


def _node(counts: Column, depth: int) -> Column:
    return F.array_join(F.slice(counts, 1, depth), ".")


def _depth(vectors: DataFrame, groups: int, node_words: int) -> int:
    """The least depth at which no node has more than ``node_words`` words."""
    depths = F.explode(F.sequence(F.lit(1), F.lit(groups)))
    sizes = (
        vectors.select("counts", depths.alias("depth"))
        .groupBy("depth", F.array_join(F.slice("counts", F.lit(1), F.col("depth")), ".").alias("node"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("depth")
        .agg(F.max("n").alias("n"))
    )
    fitting = sizes.where(F.col("n") <= node_words).agg(F.min("depth")).first()[0]
    return fitting or groups


def _searches(vectors: DataFrame, depth: int) -> DataFrame:
    """Each word at every node its budget reaches within the first ``depth`` groups."""
    ways = [
        F.struct(F.lit(more).alias("more"), F.lit(less).alias("less"))
        for more in range(-1, depth)
        for less in range(-1, depth)
        if more != less or more < 0
    ]
    first = F.slice("counts", 1, depth)
    way = vectors.select("word", first.alias("first"), F.explode(F.array(*ways)).alias("way"))
    moved = F.transform(
        "first",
        lambda c, k: c + F.when(k == F.col("way.more"), 1).otherwise(0) - F.when(k == F.col("way.less"), 1).otherwise(0),
    )
    return way.select(
        "word",
        F.array_join(moved, ".").alias("node"),
        (F.col("way.more") < 0).cast("int").alias("surplus"),
        (F.col("way.less") < 0).cast("int").alias("deficit"),
    )


def near_words(
    words: DataFrame, *, groups: int = GROUPS, node_words: int = NODE_WORDS, node_searches: int = NODE_SEARCHES
) -> DataFrame:
    """(word, n_near, best_n, best) for the words that have a word one letter apart.

    ``words`` has distinct words with their numbers (word, n). ``best`` is the near word of
    largest number, ties going to the smallest in code-point order.
    """
    ship_package(words.sparkSession)
    order = _order(words, groups)
    in_order = F.transform(F.array(vector_column(F.col("word"), groups)), lambda c: F.array(*[F.get(c, F.lit(g)) for g in order]))[0]
    vectors = staged(words.select("word", "n", in_order.alias("counts")), "vectors")
    depth = _depth(vectors, groups, node_words)
    stored = vectors.select("word", "n", _node(F.col("counts"), depth).alias("node"))
    sizes = stored.groupBy("node").agg(F.count(F.lit(1)).alias("stored"))
    searches = staged(_searches(vectors, depth).join(sizes.select("node"), "node", "left_semi"), "searches")
    asked = searches.groupBy("node").agg(F.count(F.lit(1)).alias("asked"))

    def blocks(of: str, most: int) -> Column:
        return F.ceil(F.col(of) / F.lit(most)).alias(of)

    cuts = staged(
        sizes.join(asked, "node").select("node", blocks("stored", node_words), blocks("asked", node_searches)), "cuts"
    )

    def dealt(table: DataFrame, own: str, other: str) -> DataFrame:
        """Every row in its own block, once for each block of the other side."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return (
            table.join(cuts, "node")
            .withColumn("mine", F.pmod(F.xxhash64("word"), F.col(own)))
            .withColumn("theirs", every)
            .drop("stored", "asked")
            .withColumnsRenamed({"mine": f"{own}_block", "theirs": f"{other}_block"})
        )

    keys = ["node", "stored_block", "asked_block"]
    found = (
        dealt(stored, "stored", "asked")
        .groupBy(*keys)
        .cogroup(dealt(searches, "asked", "stored").groupBy(*keys))
        .applyInArrow(_searcher(order, depth), _FOUND)
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms lead to.

    Each round doubles the steps taken. A form is several times as frequent as its word, so
    chains are short and never closed.
    """
    steps = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        taken = staged(steps.join(onward, "root").select("word", "root", "beyond"), "steps")
        steps = taken.select("word", F.col("beyond").alias("root"))
        if taken.where("root <> beyond").isEmpty():
            return steps


def group_variants(
    words: DataFrame,
    *,
    ratio: int = RATIO,
    groups: int = GROUPS,
    node_words: int = NODE_WORDS,
    node_searches: int = NODE_SEARCHES,
) -> DataFrame:
    """The form and root of each word of ``words`` (word, n).

    Returns ``word``, ``n``, ``n_near`` (words that differ from it by exactly one inserted,
    deleted or replaced code point), ``form`` (the most frequent of those, ties going to the
    smallest in code-point order, if it is at least ``ratio`` times as frequent; else null),
    ``form_n`` and ``root`` (the last word on the way along the forms; the word itself if it
    has none).

    Words must be distinct. Null words are left out; the empty word is near every word of one
    letter. An empty table gives no rows. ``ratio`` must be above 1, so that forms lead to an end.
    """
    if ratio <= 1:
        raise ValueError("the ratio must be above 1")
    known = staged(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(known, groups=groups, node_words=node_words, node_searches=node_searches)
    is_form = F.col("best_n") >= F.col("n") * ratio
    formed = staged(
        known.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    return formed.join(_roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
