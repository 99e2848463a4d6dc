"""License scans by a positional index of rare words.

Templates are word sequences, indexed by all their words with their positions. A file meets the templates
of which it has a rare word, by IDF over all documents scanned, and looks up its own license words of highest IDF: a
posting (template, position) and the word's place give the place where the template would start. Exact phrases need two words
that agree on the start, and are confirmed word by word; longer templates need several that agree
within a slack, and are confirmed by mandatory key phrases and by their share of words found there.
Of license texts that overlap (a notice that begins with another's sentence) the fuller one counts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .license_texts import TEXTS

#: A-Z lower-cased, all ASCII but letters and digits to space; bytes of other characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, in UTF-8; none for null."""
    return (text or "").encode().translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    """exact: the words stand consecutively. Else: share of the words, and key phrases, near the place."""

    label: str
    text: str
    exact: bool = True
    base: bool = False
    keys: tuple[str, ...] = ()
    share: float = 0.7


#: Phrases and license texts, with their labels.
BASE = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
]
OWN = [
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("bsd-3", "bsd 3 clause"),
    Template("cc-by-sa", "cc by sa"),
    Template("proprietary", "all rights reserved"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", False, keys=("permission is hereby granted", "without restriction")),
    Template("apache-2-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", False, keys=("except in compliance with the license",)),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False, keys=("source and binary forms", "with or without modification")),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False, keys=("free software foundation",)),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", False, keys=("with or without fee",)),
    *(Template(label, text, False, keys=keys) for label, keys, text in TEXTS),
]


class IntervalSet:
    """Spans [start, end) of which none stands by half or more in one that was there before."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.longest = 0

    def add(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, start - self.longest)
        while k < len(self.starts) and self.starts[k] < end:
            if 2 * (min(end, self.ends[k]) - max(start, self.starts[k])) >= end - start:
                return False
            k += 1
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        self.longest = max(self.longest, end - start)
        return True


@dataclass
class LicenseIndex:
    """Postings (template, position) of all template words; a file looks up its own rarest ones.

    rare names a template under its words of highest IDF: so many that what is left is less than its share (one for
    exact phrases). A file without any of these has too few of its words in any case, so by its rare words a file
    meets all templates that can be in it, and none is lost. Of each one met that has enough of its words in
    the file, the file's `anchors` words of highest IDF are looked up (two for exact phrases): the less of a text is
    left, the commoner they are.
    """

    templates: list[Template]
    idf: dict[bytes, float]
    anchors: int = 4
    slack: int = 8
    words: list[list[bytes]] = field(init=False)
    keys: list[list[list[bytes]]] = field(init=False)
    postings: dict[bytes, dict[int, list[int]]] = field(init=False)
    ranked: list[list[bytes]] = field(init=False)
    counts: list[Counter] = field(init=False)
    rare: dict[bytes, list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.words = [words_of(t.text) for t in self.templates]
        self.keys = [[words_of(k) for k in t.keys] for t in self.templates]
        self.counts = [Counter(w) for w in self.words]
        self.ranked = [sorted(c, key=lambda x: (-self.idf.get(x, math.inf), x)) for c in self.counts]
        self.postings = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(self.words):
            for q, x in enumerate(w):
                self.postings[x][i].append(q)
        self.postings = {x: dict(found) for x, found in self.postings.items()}
        self.rare = defaultdict(list)
        for i, t in enumerate(self.templates):
            left, least = len(self.words[i]), len(self.words[i]) if t.exact else t.share * len(self.words[i])
            for x in self.ranked[i]:
                if left < least:
                    break
                self.rare[x].append(i)
                left -= self.counts[i][x]

    def _lookups(self, present: set[bytes]) -> dict[int, list[bytes]]:
        """Template -> the file's words of highest IDF of it, where the file has enough of its words."""
        out = {}
        for i in sorted({i for x in present if x in self.rare for i in self.rare[x]}):
            t = self.templates[i]
            own = [x for x in self.ranked[i] if x in present]
            if own and (len(own) == len(self.ranked[i]) if t.exact else sum(self.counts[i][x] for x in own) >= t.share * len(self.words[i])):
                out[i] = own[: 2 if t.exact else self.anchors]
        return out

    def scan(self, w: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words found there) of every confirmed place."""
        lookups = self._lookups(self.postings.keys() & w)
        at: dict[bytes, list[int]] = {x: [] for own in lookups.values() for x in own}
        if at:
            for p, x in enumerate(w):
                if x in at:
                    at[x].append(p)
        out, near = [], []
        for i, own in lookups.items():
            want = self.words[i]
            if self.templates[i].exact:
                starts = set.intersection(*({p - self.postings[x][i][0] for p in at[x]} for x in own))
                out += [(i, a, 1.0) for a in sorted(starts) if a >= 0 and w[a : a + len(want)] == want]
            else:
                near += self._near(w, i, sorted((p - q, p) for x in own for p in at[x] for q in self.postings[x][i]))
        return out + self._fullest(near)

    def _fullest(self, near: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float]]:
        """Places of license texts without those of which half stands in a place with more words found (or agreed on)."""
        size = [len(x) for x in self.words]
        taken = IntervalSet()
        best = sorted(near, key=lambda x: (-x[2] * size[x[0]], -x[3], x[1], x[0]))
        return [x[:3] for x in best if taken.add(x[1], x[1] + size[x[0]])]

    def _near(self, w: list[bytes], i: int, found: list[tuple[int, int]]) -> Iterator[tuple[int, int, float, int]]:
        """Groups of starts that agree, of which enough words and all key phrases are there; each by its commonest start, with how many words agree on it."""
        n, group = len(self.words[i]), []
        need = min(2, len(set(self.words[i])))
        for start, p in [*found, (math.inf, -1)]:
            if group and (start - group[-1][0] > self.slack or start - group[0][0] > n):
                if len({w[x] for _, x in group}) >= need:
                    a, b = max(0, group[0][0] - self.slack), group[-1][0] + n + self.slack
                    part = w[a:b]
                    share = sum((Counter(part) & Counter(self.words[i])).values()) / n
                    if share >= self.templates[i].share and all(_has(part, k) for k in self.keys[i]):
                        votes = Counter(s for s, _ in group)
                        start = min(votes, key=lambda s: (-votes[s], s))
                        yield i, max(0, start), share, votes[start]
                group = []
            group.append((start, p))


def _has(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i, x in enumerate(words) if x == phrase[0])


def idf_of(docs: DataFrame, templates: list[Template]) -> dict[bytes, float]:
    """IDF of the templates' words (no others: this bounds what is gathered) over all documents."""
    vocabulary = frozenset(x for t in templates for x in words_of(t.text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
        rows = [(b"", n), *seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.int64())], names=["word", "n"])

    got = {bytes(r.word): r.n for r in docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.pop(b"", 0)
    return {x: math.log((total + 1) / (got.get(x, 0) + 1)) for x in vocabulary}


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, places array<struct<label, base, start, n_words, share>> by start, of whole texts.

    A null or empty text has no words and no places. Repeated rows are scanned each. An empty table gives no row, and all
    words then have an IDF of 0. Other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    templates = [*BASE, *OWN] if templates is None else templates
    index = LicenseIndex(templates, idf_of(docs, templates))
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = [], []
            for text in batch.column(1).to_pylist():
                w = words_of(text)
                counts.append(len(w))
                hits = sorted((s, i, share) for i, s, share in index.scan(w))
                places.append([{"label": templates[i].label, "base": templates[i].base, "start": s, "n_words": len(index.words[i]), "share": x} for s, i, x in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(place))], names=["doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<label:string,base:boolean,start:long,n_words:long,share:double>>")


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Labels, places of the base phrases and score of every document: a row for each row; a null or empty text has no words,
    no labels (empty strings), a null first and last word and score 0; no documents give no row; other columns are not read."""
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
