"""Language ID, line dedup, chat formatting, tokens, packing and decontamination."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, decontam, lang_id, line_dedup, packing, token_output
from tidemark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
LONG = "The quick brown fox jumps, over the lazy dog.\n" * 8000
ODD = [(1, None), (2, ""), (3, "  \n\t\n"), (4, "Same line\nsame line \nother"), (4, "Same line\nsame line \nother"), (None, "no id here"), (None, None), (5, "123 456"), (6, LONG), (7, "日本語 text é\x00  x"), (8, "a\n\nb\n")]


def odd(spark, rows=ODD):
    """Documents with extra columns whose names the operators use inside."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    more = ("h1", "h2", "n", "run", "key", "pos", "part", "fp", "node", "band", "rid", "count", "first", "ids", "length")
    return d.select("*", F.lit("en").alias("lang"), F.lit("src").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(7).alias(c) for c in more))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, want = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    rows = sorted(str(tuple(r[c] for c in sorted(found.columns))) for r in found.collect())
    assert rows == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


# --- language ID


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in queries()["op2_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert held and all(out[d.doc_id].held_out for d in held) and sum(r.held_out for r in out.values()) == len(held)
    known = [d for d in held if d.lang and d.text]
    assert sum(out[d.doc_id].lang_pred == d.lang for d in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_mixtures_and_undetermined_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.train(docs)
    text = {r.lang: r.text for r in docs.where("length(text) between 800 and 3000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    share, _ = lang_id.shares(model, [text["de"][:700] + text["fr"][:700], text["en"]])
    assert (share[0] > 0.3).sum() == 2 and share[1].max() > 0.95
    rows = [tuple(r) for r in lang_id.identify(odd(spark), model, ["doc_id"]).select("doc_id", "lid_lang", "lid_score").collect()]
    got = {i: (x, s) for i, x, s in rows if i is not None}
    assert [got[i] for i in (1, 2, 3, 5)] == [("und", 0.0)] * 4 and got[6][0] in text and len(rows) == len(ODD)
    none = lang_id.train(docs.limit(0))
    assert none.langs == [] and {r.lid_lang for r in lang_id.identify(odd(spark), none).collect()} == {"und"}
    assert sorted(r.doc_id or 0 for r in lang_id.keep_identified(odd(spark), none).collect()) == [0, 4, 4, 6, 7, 8]
    assert lang_id.keep_identified(odd(spark), model).columns == odd(spark).columns
    assert lang_id.identify(odd(spark, []), model).count() == 0


def test_several_languages_in_equal_shares_are_kept(spark):
    alphabets = ["abcdefg", "hijklmn", "opqrstu", "αβγδεζη", "абвгдеж"]
    import random

    rng = random.Random(3)
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(n))
    rows = [(10 * k + j, text(a, 60), f"l{k}") for k, a in enumerate(alphabets) for j in range(6)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(text(a, 60) for a in alphabets)
    share, _ = lang_id.shares(model, [mixed])
    assert (share[0] > 0.1).sum() == 5 and share.max() < 0.3
    frame = odd(spark, [(1, mixed), (2, "12 34"), (3, rows[0][1])]).withColumn("lid_text", F.lit(9))
    kept = lang_id.keep_identified(frame, model)
    assert {r.doc_id for r in kept.collect()} == {1, 3} and {r.lid_text for r in kept.collect()} == {9}
    with pytest.raises(ValueError):
        lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_langs=4)


def plain_mixture(p, counts, penalty=3.0, rounds=8):
    """Shares of one text by EM, word for word as the module describes it."""
    import math

    k = len(p[0])

    def em(share):
        for _ in range(rounds):
            new = [0.0] * k
            for h, c in counts.items():
                weights = [share[j] * p[h][j] for j in range(k)]
                for j in range(k):
                    new[j] += c * weights[j] / sum(weights)
            share = [x / sum(counts.values()) for x in new]
        return share, sum(c * math.log(sum(share[j] * p[h][j] for j in range(k))) for h, c in counts.items())

    alone = [sum(c * math.log(p[h][j]) for h, c in counts.items()) for j in range(k)]
    top = max(range(k), key=lambda j: alone[j])
    best, value = [float(j == top) for j in range(k)], alone[top]
    full, _ = em([1 / k] * k)
    order = sorted(range(k), key=lambda j: -full[j])
    for m in range(2, k + 1):
        if full[order[m - 1]] <= 0.01:
            break
        start = [full[j] if j in order[:m] else 0.0 for j in range(k)]
        share, like = em([x / sum(start) for x in start])
        like -= penalty * (m - 1) * math.log(sum(counts.values()) + 1) / 2
        if like > value:
            best, value = share, like
    return best


def test_mixtures_by_brute_force():
    rng = np.random.default_rng(12)
    p = rng.dirichlet(np.full(lang_id.BUCKETS, 0.05), 4).T.astype(np.float32) + np.float32(1e-7)
    model = lang_id.Model(list("abcd"), p)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(list(letters + "  "), rng.integers(5, 400))) for _ in range(12)]
    share, _ = lang_id.bounded_shares(model, texts)
    for text, found in zip(texts, share, strict=True):
        h = Counter(lang_id._hashes(text)[0].tolist())
        assert np.allclose(plain_mixture(p.astype(float), h), found, atol=1e-6)


def test_long_texts_are_counted_in_segments(monkeypatch):
    text = "Der Text ist lang und " * 300
    _, h, c = lang_id._counts([text])
    monkeypatch.setattr(lang_id, "SEGMENT", 512)
    _, h2, c2 = lang_id._counts([text])
    whole, parts = dict(zip(h, c, strict=True)), dict(zip(h2, c2, strict=True))
    assert sum(whole.values()) == sum(parts.values()) and sum(abs(whole.get(k, 0) - parts.get(k, 0)) for k in whole | parts) < 60


# --- line dedup


def cleaned(rows, documents, least=1):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for _, t in rows]
    n = Counter(k for own in keys for k in set(own) if len(k) >= least)
    return Counter((i, "\n".join(x for x, k in zip((t or "").split("\n"), own, strict=True) if n[k] < documents)) for (i, t), own in zip(rows, keys, strict=True))


def test_common_lines_of_odd_rows(spark):
    out = line_dedup.drop_common_lines(odd(spark), documents=2)
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == cleaned(ODD, 2)
    assert set(odd(spark).columns) < set(out.columns)
    assert line_dedup.drop_common_lines(odd(spark, []), documents=2).count() == 0


def test_runs_grow_in_batches_and_compact(spark):
    rows = [(i, f"line {i % 3}\nLINE {i % 5} \nown {i}") for i in range(40)]
    runs = line_dedup.LineRuns(spark, documents=10)
    for k in range(4):
        runs.add(odd(spark, rows[10 * k : 10 * k + 10]))
    assert [bool(r) for r in runs.levels] == [False, False, True]
    assert Counter((r.doc_id, r.text) for r in runs.clean(odd(spark, rows)).collect()) == cleaned(rows, 10)
    assert line_dedup.LineRuns(spark, 1).clean(odd(spark, rows)).where("_ld_dropped > 0").count() == 0
    runs.drop()


def test_a_batch_leaves_settled_lines_out(spark):
    rows = [(i, f"common\nown {i}") for i in range(9)]
    runs = line_dedup.LineRuns(spark, documents=3)
    runs.add(odd(spark, rows[:4]))
    runs.add(odd(spark, rows[4:]))
    assert sorted(r.n for r in line_dedup.table(spark, runs.levels[1]).collect()) == [1] * 9 + [4]  # the second batch has no entry for the common line
    runs.add(odd(spark, [(9, "own 9")]))
    assert Counter((r.doc_id, r.text) for r in runs.clean(odd(spark, rows)).collect()) == cleaned(rows, 3)
    one, two = (line_dedup.table(spark, r) for r in runs.runs())
    for frame in (runs.unsettled(one), runs.merged(one, two)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_first_documents_of_later_batches(spark):
    rows = [(i, f"common\nown {i}") for i in (5, 6, 7, 1, 8, 9)]
    runs = line_dedup.LineRuns(spark, documents=3, keep_first=True)
    runs.add(odd(spark, rows[:3]))
    runs.add(odd(spark, rows[3:]))
    assert {r.doc_id for r in runs.clean(odd(spark, rows)).collect() if r.text.startswith("common")} == {1}


def test_own_column_names(spark):
    frame = odd(spark).withColumns({c: F.lit(5) for c in ("_ld_h", "_ld_drop", "_ld_rest", "_ld_pos", "_ld_key", "_ld_lines")})
    out = line_dedup.drop_common_lines(frame, documents=2)
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == cleaned(ODD, 2) and {r._ld_h for r in out.collect()} == {5}


def test_the_first_document_may_keep_its_lines(spark):
    rows = [(3, "common\nc"), (1, "common\na"), (2, " COMMON\nb"), (None, "common\nd")]
    out = line_dedup.drop_common_lines(odd(spark, rows), documents=2, keep_first=True)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "common\na", 2: "b", 3: "c", None: "d"}


# --- chat formatting


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]"]), st.text(st.sampled_from("<>/s[]INSTROLE\\ x\n")))))
def test_rendering_is_reversible(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 1, "assistant", None), (2, None, None, "<s>\\</s>é"), (None, 0, "user", "alone"), (None, 0, "assistant", "also alone"), (3, 0, "assistant", "[/INST] ok " * 9000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = {(r.conv_id, r.n_turns, r.loss_chars): r for r in chat_format.read_back(chat_format.format_chats(frame)).collect()}
    assert set(out) == {(1, 3, 0), (2, 1, 0), (None, 1, 0), (None, 1, 10), (3, 1, 99_000)}
    assert out[3, 1, 99_000].loss_sha256 == hashlib.sha256(("[/INST] ok " * 9000).encode()).hexdigest()
    assert chat_format.format_chats(frame.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, None, "a", None), (None, None, None, "a"), (None, 1, "a", "b"), (None, 1, "a", "b")], frame.drop("turns").schema)
    assert [r.n_turns for r in chat_format.read_back(chat_format.format_chats(alone)).collect()] == [1, 1, 1, 1]


def test_masks_are_found_by_binary_search():
    offsets = np.array([(0, 3), (3, 5), (5, 5), (5, 9), (9, 12)])
    assert chat_format.mask(offsets, [(3, 9)]).tolist() == [False, True, True, True, False]
    assert not chat_format.mask(offsets, [(3, 3), (12, 12)]).any()


# --- tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab 1.'\n\té_ñsS²…ªµº")), max_size=60), max_size=5))
def test_the_encoder_agrees_with_the_library(tokenizer, texts):
    made = list(small_encoder().many(texts))
    assert [x.tolist() for x in made] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def small_encoder(cache={}):
    return cache.setdefault(0, common.Encoder(common.vocabulary("byte_bpe_50k.json"), most=200))


def test_long_and_special_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(common, "_PIECE", 1000)
    for t in (LONG[:20_000], "word " * 900 + "<|endoftext|> " + "日本 " * 900, "x" * 5000, "a  b   c \n\n d" * 500):
        assert common.encoder("byte_bpe_50k.json")(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def starts(rows, tokenizer, end):
    out, at = Counter(), 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    return out, at


def test_token_files(spark, tmp_path, tokenizer):
    path = f"file://{tmp_path}/tokens"
    token_output.write_tokens(odd(spark), path)
    rows = token_output.with_starts(token_output.read_tokens(spark, path)).orderBy("start").collect()
    want, total = starts(ODD, tokenizer, 2)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)]).tolist()[:-1] and rows[-1].start + rows[-1].n_tokens == total
    assert [r.doc_id or 0 for r in rows] == sorted(r.doc_id or 0 for r in rows)
    found = token_output.read_tokens(spark, path, [5, 99])
    assert [r.doc_id for r in found.collect()] == [5] and "doc_id" in found._jdf.queryExecution().toString().split("PushedFilters")[1]
    token_output.write_tokens(odd(spark, []), f"file://{tmp_path}/none")
    assert token_output.with_starts(token_output.read_tokens(spark, f"file://{tmp_path}/none")).count() == 0


def test_token_query(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries()["op10_token_output"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == starts(rows, tokenizer, 2)[0]
    at = 0
    for r in sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens


# --- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plans_use_each_piece_once(lengths):
    plan = packing.best_two_fit(dict(Counter(lengths)), 40)
    used = Counter()
    for filled, times in plan:
        assert sum(filled) <= 40 and times > 0
        for n in filled:
            used[n] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in plan) <= 1.25 * (sum(lengths) / 40) + 1 or max(lengths) > 10


def test_two_shorter_pieces_replace_the_smallest():
    # greedy: 6+3, gap 1; 3 goes for 2+2
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ([6, 2, 2], 1) and plan[1] == ([3], 1)


def check_packing(rows, tokenizer, capacity):
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_document.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return by_sequence, by_document


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, tokenizer, capacity):
    rows = packing.pack(odd(spark), capacity=capacity).collect()
    _, by_document = check_packing(rows, tokenizer, capacity)
    want = Counter()
    for i, t in ODD:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        at, k = 0, 0
        n = len(ids) % capacity or capacity
        while at < len(ids):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k, n = at + n, k + 1, capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack(odd(spark, [])).count() == 0


def test_packing_query(spark, tokenizer):
    rows = queries()["op7_best_fit_packing"](spark, SF).collect()
    by_sequence, by_document = check_packing(rows, tokenizer, 2048)
    assert len(by_document) == 200 and len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


# --- decontamination

QUESTION = "Maria has 12 apples and gives 5 of them to Peter before she walks 3 km to school with Maria and Anna."


def test_reparameterised_questions(spark):
    texts = {
        1: f"Before. {QUESTION} After.",
        2: "So Clara has 30 apples and gives 7 of them to Tom before she walks 9 miles to school with Clara and Eva.",
        3: "So Clara has 30 apples and gives 7 of them to Tom before she walks 9 miles to school with Tom and Eva.",
        4: "A clean text about apples and about a school, and nothing else that matters to anyone at all.",
        5: None,
        6: "",
        7: LONG + QUESTION,
        8: QUESTION.upper(),
        9: f"so {QUESTION.lower()}",
    }
    bench = spark.createDataFrame([(10, QUESTION), (11, None), (12, ""), (13, "too short"), (None, "an item without an id is still an item of the benchmark")], "item_id long, text string")
    docs = odd(spark, [*texts.items(), (1, texts[1]), (None, f"x {QUESTION}")])
    found = decontam.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id, r.renamed) for r in found) == Counter({(1, 10, False): 2, (2, 10, True): 1, (7, 10, False): 1, (8, 10, False): 1, (9, 10, False): 1, (None, 10, False): 1})
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_inconsistent_slots_leave_words_that_are_repeated(spark):
    item = "Tom buys 5 red apples and 5 green pears from the old market near the river every single morning before school"
    other = "Yesterday we saw Anna give 12 coins and 30 stamps to the museum of her town"
    texts = {1: item.replace("5 green", "7 green"), 2: other.replace("12", "40").replace("30", "40"), 3: item.replace("5 red", "6 red").replace("market", "shop").replace("single", "late")}
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    found = decontam.contaminated(odd(spark, [*texts.items()]), bench).collect()
    assert {(r.doc_id, r.item_id, r.renamed) for r in found} == {(1, 1, False), (2, 2, True)}
    assert [r.doc_id for r in decontam.decontaminate(odd(spark, [*texts.items()]), bench).collect()] == [3]


def test_small_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BITS", 1 << 12)
    items = [(k % 9, f"{QUESTION[:60]} number {k} and some more words that only item {chr(97 + k) * 5} has got in it") for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(odd(spark, [(k, t) for k, (_, t) in enumerate(items)]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(k, k % 9) for k in range(12)}


def test_scripts_without_spaces(spark):
    item = "小明有十二个苹果他给了小红五个然后走路去学校上课"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontam.contaminated(odd(spark, [(1, f"前面{item}后面"), (2, "今天天气很好我们去公园散步吧")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]


def plain_contaminated(item, doc):
    """Whether an item of words contaminates a document: every diagonal, window by window, by the rules as they are written."""
    import re

    def read(text):
        words = re.findall(r"[^\W_]+|[.!?\n]", text)
        out, start, number = [], True, False
        for w in words:
            if w in ".!?\n":
                start = True
                continue
            low = w.lower()
            is_number = low[0].isdigit() or low in decontam.NUMBERS
            kind = "N" if is_number else "A" if w[0].isupper() and w[1:].islower() and not start else "U" if low in decontam.UNITS and number else ""
            if low in decontam.UNITS and number:
                kind = "U"
            out.append((kind or low, low))
            start, number = False, is_number
        return out

    a, b = read(item), read(doc)
    n = min(8, len(a))
    if n < 4:
        return False
    covered, longest = set(), 0
    for shift in range(-len(a), len(b)):
        at = [i for i in range(len(a)) if 0 <= i + shift < len(b)]
        template, plain = set(), set()
        for i in at:
            own = range(i, i + n)
            if i + n > len(a) or i + n + shift > len(b):
                continue
            if all(a[k][1] == b[k + shift][1] for k in own):
                plain.update(own)
                template.update(own)
            elif all(a[k][0] == b[k + shift][0] for k in own) and 2 * sum(a[k][0] == a[k][1] for k in own) >= n:
                template.update(own)
        if not template:
            continue
        slots = [(a[k][0], a[k][1], b[k + shift][1]) for k in template if a[k][0] != a[k][1]]
        forth = {x: {z for _, y, z in slots if y == x} for _, x, _ in slots}
        back = {z: {y for t, y, w in slots if w == z and t != "N"} for t, _, z in slots if t != "N"}
        if any(len(v) > 1 for v in [*forth.values(), *back.values()]):
            template = plain
        covered |= template
        run = 0
        for k in range(len(a)):
            run = run + 1 if k in template and a[k][1] == b[k + shift][1] else 0
            longest = max(longest, run)
    return len(covered) >= 0.6 * len(a) or longest >= 13


def test_templates_and_slots_by_brute_force(spark):
    import random

    rng = random.Random(6)
    names, units, plain = "Maria Peter Clara Tom Anna Eva".split(), "km miles hours".split(), "has gives apples to school before she walks with coins market river stamps museum of town".split()

    def sentence(k):
        out = ["So"]
        for _ in range(k):
            out.append(rng.choice([rng.choice(names), str(rng.randrange(2, 6)), f"{rng.randrange(2, 5)} {rng.choice(units)}", *rng.choices(plain, k=5)]))
        return " ".join(out)

    items = [sentence(rng.randrange(3, 26)) for _ in range(25)]
    docs = []
    for _ in range(160):
        words = rng.choice(items).split()
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(words))
            w = words[k]
            words[k] = rng.choice(names) if w in names else str(rng.randrange(2, 9)) if w.isdigit() else rng.choice(plain)
        docs.append(" ".join([sentence(rng.randrange(0, 9)), *words, sentence(rng.randrange(0, 9))]))
    found = decontam.contaminated(odd(spark, list(enumerate(docs))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if plain_contaminated(item, doc)}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and 20 < len(want) < 25 * 160 // 2


def test_planted_passages(spark):
    """Every passage that shares eight words in a row with an item, by brute force."""
    import re

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    where = {}
    for i in items:
        w = words(i.text)
        for k in range(len(w) - 7):
            where.setdefault(tuple(w[k : k + 8]), set()).add(i.item_id)
    want = {(d.doc_id, i) for d in docs for w in [words(d.text)] for k in range(len(w) - 7) for i in where.get(tuple(w[k : k + 8]), ())}
    assert {(r.doc_id, r.item_id) for r in queries()["op9_benchmark_decontamination"](spark, SF).collect()} == want and want
