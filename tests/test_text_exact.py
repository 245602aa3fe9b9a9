"""Queries that SQL cannot express, row by row against plain reimplementations on the smallest tables."""

import collections
import difflib
import html.parser
import math
import re

from deltascope import registry
from deltascope.plans import text as plans

DIR = "/root/testdata/sf0.001"


def rows(spark, name, key):
    out = collections.defaultdict(list)
    for r in registry.queries()[name](spark, DIR).collect():
        out[tuple(r[k] for k in key)].append(r)
    return out


def paragraphs(text):
    lines = [" ".join(re.findall(r"[^ \t\n\x0b\f\r]+", x)) for x in text.split("\n")]
    return [x for x in lines if len(x.split(" ")) >= 15]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def pairs(spark):
    return {(r.doc_id,): (paragraphs(r.new_text), paragraphs(r.old_text), r.new_text != r.old_text) for r in plans.versions(spark, DIR).collect()}


def turns(spark):
    return {(r.conv_id, r.turn): (r.old, r.new) for r in plans._conversation_versions(spark, DIR).collect()}


def test_greedy_alignment(spark):
    got = rows(spark, "greedy_alignment", ["doc_id"])
    for key, (new, old, _) in pairs(spark).items():
        docs = [re.findall("[a-z]+", p.lower()) for p in new + old]
        weight = lambda t, d: d.count(t) / len(d) * (math.log((len(docs) + 1) / (sum(t in x for x in docs) + 1)) + 1)
        vectors = [{t: weight(t, d) for t in set(d)} for d in docs]
        size = [math.sqrt(sum(v * v for v in x.values())) for x in vectors]
        every = [(sum(v * vectors[len(new) + j].get(t, 0) for t, v in vectors[i].items()) / (size[i] * size[len(new) + j]), i, j) for i in range(len(new)) for j in range(len(old))]
        want, left_new, left_old = set(), set(range(len(new))), set(range(len(old)))
        for s, i, j in sorted((round(s, 12), i, j) for s, i, j in every if s >= 0.5)[::-1]:
            if i in left_new and j in left_old:
                left_new.discard(i)
                left_old.discard(j)
                want.add(("unchanged" if s >= 0.95 else "revised", i, j, round(s, 4)))
        want |= {("added", i, -1, 0.0) for i in left_new} | {("removed", -1, j, 0.0) for j in left_old}
        assert {(r.change, r.new_at, r.old_at, round(r.score, 4)) for r in got[key]} == want


def test_opcode_alignment(spark):
    got = rows(spark, "opcode_alignment", ["doc_id"])
    for key, (new, old, differs) in pairs(spark).items():
        own = got.get(key, [])
        if not differs:
            assert own == []
            continue
        # every paragraph once, in order; equal ones score 1, replaced ones their character ratio
        assert sorted(r.new_at for r in own if r.new_at >= 0) == list(range(len(new))) and sorted(r.old_at for r in own if r.old_at >= 0) == list(range(len(old)))
        both = sorted((r.new_at, r.old_at) for r in own if min(r.new_at, r.old_at) >= 0)
        assert [j for _, j in both] == sorted(j for _, j in both)
        for r in own:
            if r.change in ("added", "removed"):
                assert r.score == 0 and (r.new_at if r.change == "removed" else r.old_at) == -1
            else:
                s = ratio(old[r.old_at], new[r.new_at])
                assert abs(r.score - s) < 1e-5 and r.change == ("unchanged" if s >= 0.95 else "revised")


def test_char_similarity(spark):
    got = rows(spark, "char_similarity", ["conv_id", "turn"])
    want = turns(spark)
    assert set(got) == set(want)
    for key, (old, new) in want.items():
        assert abs(got[key][0].similarity - ratio(old, new)) < 1e-5


def test_word_diff_spans(spark):
    got = rows(spark, "word_diff_spans", ["conv_id", "turn"])
    for key, (old, new) in turns(spark).items():
        matcher = difflib.SequenceMatcher(None, old.split(), new.split(), autojunk=False)
        same = collections.Counter(w for a, _, n in matcher.get_matching_blocks() for w in old.split()[a : a + n])
        spans = collections.defaultdict(collections.Counter)
        for r in got[key]:
            spans[r.tag].update(r.text.split())
        assert spans["equal"] == same and spans["equal"] + spans["removed"] == collections.Counter(old.split()) and spans["equal"] + spans["added"] == collections.Counter(new.split())


def test_sentence_novelty(spark):
    got = rows(spark, "sentence_novelty", ["conv_id", "turn"])
    cut = lambda t: [x.strip(" ") for x in re.split(r"(?<=[.!?])\s+", t) if len(x.strip(" ")) > 20]
    for key, (old, new) in turns(spark).items():
        want = [s for s in cut(new) if all(ratio(o, s) < 0.75 for o in cut(old))][:20]
        assert [r.sentence for r in got.get(key, [])] == want


class Words(html.parser.HTMLParser):
    """Words outside of scripts, styles, heads and what is not displayed."""

    def __init__(self, only=None):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden, self.only, self.inside = [], [], only, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "meta", "link", "input", "hr", "col", "wbr", "source", "area", "base", "embed", "param", "track"):
            return
        if self.hidden or tag in ("script", "style", "head", "noscript") or "display:none" in (dict(attrs).get("style") or "").replace(" ", "").lower():
            self.hidden.append(tag)
        self.inside += tag == self.only

    def handle_endtag(self, tag):
        if self.hidden and tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        self.inside -= tag == self.only

    def handle_data(self, data):
        if not self.hidden and (self.only is None or self.inside):
            self.words.append(data)


def test_page_block_text(spark):
    got = rows(spark, "page_block_text", ["page_id"])
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        reader = Words()
        reader.feed(r.html)
        reader.close()
        assert "".join(got[r.page_id,][0].text.split()) == "".join("".join(reader.words).split())
        assert "\n\n\n" not in got[r.page_id,][0].text and got[r.page_id,][0].text == got[r.page_id,][0].text.strip()


def test_page_article_text(spark):
    got = rows(spark, "page_article_text", ["page_id"])
    short = 0
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        reader = Words("article")
        reader.feed(r.html)
        reader.close()
        words, mine = collections.Counter("".join(reader.words).split()), collections.Counter(got[r.page_id,][0].text.split())
        if sum(words.values()) < 100:
            short += 1  # the whole page stands in for a short article
            continue
        assert sum((mine - collections.Counter(" ".join(reader.words).split())).values()) <= 0.02 * sum(words.values()) + 5
        assert sum(mine.values()) >= 0.5 * sum(words.values())
    assert short < len(got)
