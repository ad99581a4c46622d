"""Every registered query of the training-data operators, called through queries(), against brute force over its whole tables."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import SparkSession

import __spark_entry__
from gatewell.llm import decontam, fingerprint, token_counts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
crc = lambda i, m: zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def rows(sql):
    return duckdb.sql(sql).fetchall()


DOCS = rows(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id")
PAGES = rows(f"select page_id, url, html from '{SF}/pages.parquet' order by page_id")
ITEMS = rows(f"select item_id, text from '{SF}/benchmark.parquet'")


def run(spark, name):
    found = __spark_entry__.queries()[name](spark, SF).collect()
    key = found[0].__fields__[0]
    assert len(found) == (len(PAGES) if key == "page_id" else len(found) if name.startswith("op10") else len(DOCS))
    return {r[key]: r for r in found}


def test_op1(spark):
    got = run(spark, "op1_language_id")
    for i, text, lang, _ in DOCS:
        r = got[i]
        assert r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    asked = [(got[i]["lang_pred"], lang) for i, _, lang, _ in DOCS if crc(i, 4) == 2 and lang is not None and got[i]["lang_pred"] != "und"]
    assert sum(a == b for a, b in asked) >= 0.97 * len(asked)


def test_op2(spark):
    got = run(spark, "op2_quality")
    assert all(r["held_out"] == (crc(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    labels = [(i, q) for i, q in rows(f"select doc_id, quality from '{SF}/labels.parquet'") if crc(i, 3) == 1]
    assert sum(got[i]["predicted"] == q for i, q in labels) >= 0.9 * len(labels)


def hits():
    """Of each document: number of words, of words hit, and the items hit."""
    win = defaultdict(set)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for item, text in ITEMS:
        w = words(text)
        for k in range(max(1, len(w) - 12)) if w else []:
            win[tuple(w[k : k + 13])].add(str(item))
    sizes = {len(x) for x in win}
    out = {}
    for i, text, *_ in DOCS:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    items |= win[tuple(w[k : k + n])]
        out[i] = len(w), len(hit), sorted(items)
    return out


def test_op3(spark):
    got = run(spark, "op3_decontamination")
    for i, (n, hit, items) in hits().items():
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(items), sha(",".join(items)))
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_op3_slop(spark):
    """Proximity matches: each term may stand up to slop places off its own."""
    bench = spark.createDataFrame([(1, "a b c d")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "a x x b c d"), (4, "d c b a x x x x"), (5, None), (6, "a b c")], "doc_id int, text string")
    found = {s: sorted(r["doc_id"] for r in decontam.contamination(docs, bench, ["doc_id"], slop=s).collect() if r["items"]) for s in (0, 1, 2)}
    assert found == {0: [1], 1: [1, 2], 2: [1, 2, 3]}


def units(text):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", text) if x]
    w = w if len(w) >= fingerprint.FEW else list(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_op4(spark):
    got, near = run(spark, "op4_fingerprints"), lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(DOCS, key=lambda r: -r[0])
    off = []
    for k, (i, text, *_) in enumerate(order):
        t, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r, a, b, c = got[i], units(t), units(edited), units(after)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        off += [abs(r["near_edited"] - near(a, b)), abs(r["near_next"] - near(a, c)), abs(r["edited_contained"] - (len(a & b) / len(b) if b else 1.0)) / 2]
        assert len(r["fingerprint"]) == 16 * min(len(a), fingerprint.K) and abs(r["distinct_shingles"] - len(a)) <= 0.4 * len(a)
        assert len(a | b) > fingerprint.K or off[-3] < 1e-9  # small sets are compared exactly
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03
    by_text = defaultdict(set)
    for i, text, *_ in DOCS:
        by_text[text or ""].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def classes(texts):
    """{id: (set size, smallest id reachable)}; sets meet by the shingles that they share."""
    sets, at = {}, defaultdict(list)
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])
        for s in sets[i]:
            at[s].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op5(spark):
    got = run(spark, "op5_near_duplicates")
    for i, (n, component) in classes([(i, t) for i, t, *_ in DOCS]).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KINDS = ("assign", "access", "hex", "bare")


def found_spans(text):
    """Base spans and bare candidates: (start, kind, end, value)."""
    base = [(m.start(), 0, m.end(), re.sub(r"^=+|\.+$", "", m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    bare = set()
    for m in re.finditer("[A-Za-z0-9+/_.=-]{12,}", text):
        cuts, at = {(0, len(m[0]))} if not re.search("[/=]", m[0]) else set(), 0
        for part in re.split("[/=]", m[0]) if re.search("[/=]", m[0]) else []:
            cuts |= {(at, at + len(part)), (at, len(m[0]))}
            at += len(part) + 1
        for a, b in cuts:
            value = m[0][a:b].rstrip(".")
            if b - a >= 12 and len(value) >= 12:
                bare.add((m.start() + a, 3, m.start() + a + len(value), value))
    return base, [x for x in bare if not any(y[0] <= x[0] and x[2] <= y[2] for y in base)]


def judged_spans(docs):
    """{id: spans as (start, kind, end, live)} by ownership over the documents (id, text, source)."""
    spans, repos, owners, named, based = {}, defaultdict(set), defaultdict(set), set(), set()
    for i, text, source in docs:
        base, bare = spans[i] = found_spans(text or "")
        for _, kind, _, value in base + bare:
            repos[value].add(i)
            owners[value].add(source)
            named |= {value} if kind < 2 else set()
            based |= {value} if kind < 3 else set()
    live = lambda v: len(owners[v]) < 3 and len(repos[v]) < 50
    return {i: sorted((s, k, e, live(v)) for s, k, e, v in base + [x for x in bare if x[3] in named]) for i, (base, bare) in spans.items()}


def test_op6(spark):
    got = run(spark, "op6_secrets")
    for i, spans in judged_spans([(i, t, s) for i, t, _, s in DOCS]).items():
        r, listed = got[i], lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in x)
        assert (r["spans"], r["base_sha256"]) == (listed(spans), sha(listed([x for x in spans if x[1] < 3])))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert (r["n_live"], r["n_example"]) == (sum(x[3] for x in spans), sum(not x[3] for x in spans))


def test_op7(spark):
    got = run(spark, "op7_pieces")
    for i, text, *_ in DOCS:
        ids = LIBRARY.encode(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_op8(spark):
    got, last = run(spark, "op8_warc"), {}
    for i, _, html in PAGES:
        last[html or ""] = max(last.get(html or "", i), i)
    for i, url, html in PAGES:
        data, r, of = (html or "").encode(), got[i], last[html or ""]
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if of == i else ("revisit", of))


def test_op9(spark):
    got = run(spark, "op9_html_text")
    for i, url, page in PAGES:
        article = re.search("<article>(.*)</article>", page, re.S)[1]
        assert "<article" not in article and not re.search("<(div|aside|nav|form)", article)
        text = " ".join(re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]*>", " ", article)).split())
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&middot;", "·"), ("&amp;", "&")):
            text = text.replace(name, char)
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, text, len(text))


def test_op10(spark):
    got = __spark_entry__.queries()["op10_token_counts"](spark, SF).collect()
    encode = token_counts.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    lengths = [len(encode(t or "")) for _, t, *_ in DOCS]
    assert {r["n_tokens"]: r["docs"] for r in got} == Counter(lengths)
    for r in got:
        n = r["n_tokens"]
        assert (r["tokens_from"], r["docs_from"], r["truncated_total"]) == (sum(x for x in lengths if x >= n), sum(x >= n for x in lengths), sum(min(x, n) for x in lengths))


def test_pipeline(spark):
    """run() against the five stages in plain Python; languages decide by their absence only."""
    docs = [(i, t, s) for i, t, _, s in DOCS if any(map(str.isalpha, t or ""))]
    component = classes([(i, t) for i, t, _ in docs])
    docs = [d for d in docs if component[d[0]][1] == d[0]]
    hit = hits()
    docs = [d for d in docs if not (hit[d[0]][1] and 20 * hit[d[0]][1] >= hit[d[0]][0])]
    spans, want = judged_spans(docs), {}
    for i, text, _ in docs:
        out, at = "", 0
        for s, _, e, live in spans[i]:
            if live:
                out, at = (out + text[at:s] + "[REDACTED]" if s >= at else out), max(at, e)
        ids = LIBRARY.encode(out + text[at:])
        want[i] = len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in __spark_entry__.queries()["pipeline"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["op3_decontamination", "op5_near_duplicates", "op8_warc"])
def test_sql(spark, name):
    """The SQL gives the rows of the query."""
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = __spark_entry__.oracle_sql()[name]
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    rows = duck.sql(f"select {', '.join(sorted(want.columns))} from ({sql})").fetchall()
    assert sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()) == sorted(tuple(map(str, r)) for r in rows)
