"""Masking of summaries by their facts: what no fact covers is revealed first, then slots at random until a share of the words is."""

from __future__ import annotations

import random
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexisift.functions.text import MASK, SUBQUERY


@dataclass(frozen=True)
class Masking:
    """How summaries are masked.

    ``ratio``: share of the words inside facts that are to show. ``verb_as_slot``: a fact's verb is a slot like its arguments; else it is no part
    of the fact. ``rand_expose``: a sentence whose words are all inside facts shows a random slot from the start. ``remove_base``: words
    outside of facts count as shown but are left out of the result, as are sentences that are masks only. ``func_ratio``: share of the words
    outside of facts that show. ``max_words``: cut of the result. ``trials``: slots tried in a row that show nothing new. ``seed``: alike everywhere.
    """

    ratio: float = 0.0
    verb_as_slot: bool = False
    rand_expose: bool = False
    remove_base: bool = False
    func_ratio: float = 1.0
    max_words: int | None = None
    trials: int = 100
    seed: int = 2020

    def __post_init__(self):
        for share in (self.ratio, self.func_ratio):
            if not 0 <= share <= 1:
                raise ValueError(f"ratio {share}")

    @property
    def roles(self) -> tuple[str, ...]:
        return (("V",) if self.verb_as_slot else ()) + ("ARG0", "ARG1", "ARG2")

    def name(self) -> str:
        """A run's name: the ratio, then what differs from the defaults."""
        changed = [f.name if v is True else f"{f.name}-{v}" for f in fields(self) if f.name != "ratio" and (v := getattr(self, f.name)) != f.default]
        return "-".join([f"reveal_{self.ratio}", *changed])


def covered(tags: Column, roles: tuple[str, ...] = ("V", "ARG0", "ARG1", "ARG2")) -> Column:
    """Positions of the words of a fact's roles, from tags that end with them."""
    return F.array_compact(F.transform(tags, lambda t, i: F.when(t.rlike(f"({'|'.join(roles)})$"), i)))


def base_revealed(words: Column, facts: Column, roles: tuple[str, ...] = ("V", "ARG0", "ARG1", "ARG2")) -> Column:
    """The words with all that facts cover masked; ``facts`` is an array of tag arrays."""
    inside = F.array_distinct(F.flatten(F.transform(facts, lambda t: covered(t, roles))))
    return F.transform(words, lambda w, i: F.when(F.array_contains(inside, i), F.lit(MASK)).otherwise(w))


class _Sentence:
    """What shows of a sentence, and the slots of each of its facts that haven't been used."""

    def __init__(self, words: list[str], facts: list[list[str]], how: Masking, rng: random.Random):
        spans = [[{i for i, t in enumerate(tags) if t.endswith(role)} for role in how.roles] for tags in facts]
        self.words, self.rng = words, rng
        self.facts = [[s for s in own if s] for own in spans]
        base = set(range(len(words))).difference(*(s for own in self.facts for s in own))
        if not base and how.rand_expose and any(self.facts):
            base = self.draw()
        self.shown = sorted(base)
        if how.func_ratio < 1 and len(base) > 1:
            self.shown = rng.sample(self.shown, int(len(base) * how.func_ratio))
        self.base, self.shown = set(self.shown), set(self.shown)
        self.reachable, self.outside = len(words) - len(base) + len(self.base), len(base)

    def draw(self) -> set[int]:
        """A random slot of a random fact that has one; it and the fact's slots inside it are used up."""
        own = self.rng.choice([f for f in self.facts if f])
        slot = self.rng.choice(own)
        own[:] = [s for s in own if not s <= slot]
        return slot

    def more(self, trials: int) -> bool:
        """Shows one more slot that has a hidden word; false if there is none."""
        for _ in range(trials):
            if len(self.shown) >= self.reachable or not any(self.facts):
                return False
            new = self.draw() - self.shown
            if new:
                self.shown |= new
                return True
        return False

    def result(self, remove_base: bool) -> list[str]:
        out = [w if i in self.shown else MASK for i, w in enumerate(self.words) if not (remove_base and i in self.base)]
        return [] if remove_base and set(out) == {MASK} else merged(out)


def reveal(sentences: list[tuple[list[str], list[list[str]]]], how: Masking, key: str = "") -> tuple[list[list[str]], int]:
    """Masked words of each sentence of a summary, and how many words show.

    Words outside of facts show first. Then a slot of each sentence in turn, until ``int(shown + (words - outside) * ratio)`` words show or no
    sentence has more; at a ratio of 0 one slot shows all the same.
    """
    rng = random.Random(f"{how.seed}:{key}")
    own = [_Sentence(words, facts, how, rng) for words, facts in sentences]
    shown = lambda: sum(len(s.shown) for s in own)
    goal = int(shown() + (sum(len(s.words) for s in own) - sum(s.outside for s in own)) * how.ratio)
    going = True
    while going:
        going = False
        for s in own:
            if s.more(how.trials):
                going = shown() < goal
                if not going:
                    break
    return [s.result(how.remove_base) for s in own], shown()


def merged(words: list[str]) -> list[str]:
    return [w for i, w in enumerate(words) if w != MASK or not i or words[i - 1] != MASK]


def joined(parts: list[list[str]], mark: str | None, most: int | None) -> list[str]:
    """Sentences that aren't empty, with a mark between them, cut."""
    own = [p for p in parts if p]
    return [w for i, p in enumerate(own) for w in ([mark] if mark and i else []) + p][:most]


def masked_summaries(parses: DataFrame, how: Masking) -> DataFrame:
    """``(cid, masked_seq, masked_seq_with_sep, masked_seq_with_sub, n_revealed, n_base)`` of ``parses(cid, open_ie)``; a summary is one row.

    Summaries are masked one by one, seeded by their cid. An empty parse gives empty sequences.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cid, parse in zip(pdf["cid"], pdf["open_ie"], strict=True):
            sentences = [(list(s["words"]), [list(v["tags"]) for v in s["verbs"]]) for s in (parse if parse is not None else [])]
            parts, n = reveal(sentences, how, cid)
            base = sum(all(not t[i].endswith(how.roles) for t in tags) for words, tags in sentences for i in range(len(words)))
            out.append((cid, *(joined(parts, mark, how.max_words) for mark in (None, "[SEP]", SUBQUERY)), n, base))
        return pd.DataFrame(out, columns=["cid", "masked_seq", "masked_seq_with_sep", "masked_seq_with_sub", "n_revealed", "n_base"])

    schema = "cid string, masked_seq array<string>, masked_seq_with_sep array<string>, masked_seq_with_sub array<string>, n_revealed long, n_base long"
    return parses.select("cid", "open_ie").mapInPandas(lambda batches: map(one, batches), schema)


def statistics(masked: DataFrame) -> DataFrame:
    """``(n_summaries, without_base, mean_words, mean_masks, mean_revealed)`` of masked summaries."""
    masks = F.size(F.filter("masked_seq", lambda w: w == MASK))
    rows = masked.select(F.size("masked_seq").alias("w"), masks.alias("m"), "n_revealed", "n_base")
    return rows.agg(F.count("*").alias("n_summaries"), F.count_if(F.col("n_base") == 0).alias("without_base"), F.round(F.avg("w"), 4).alias("mean_words"), F.round(F.avg("m"), 4).alias("mean_masks"), F.round(F.avg("n_revealed"), 4).alias("mean_revealed"))


def random_mask(words: DataFrame, count, seed: int = 2020) -> DataFrame:
    """The ablation: ``count`` words (a number or a column) of each ``(cid, i, word)`` summary show, in the order of a hash; the others are masks."""
    order = W.partitionBy("cid").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "cid", F.col("i").cast("string"))), "i")
    return words.withColumn("_r", F.row_number().over(order)).withColumn("word", F.when(F.col("_r") <= count, F.col("word")).otherwise(MASK)).drop("_r")
