"""Each operator against a plain version of itself on small tables with odd rows."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, html_text, mixing, near_copies, quality, repeats, secret_scan, token_counts, vector_search
from oracle import connect, difference, duck_rows, spark_rows

WORD = re.compile(r"[^ \t-\r]+")
DOCS = "doc_id long, text string, source string, n_words int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randrange(5, 200))) for _ in range(12)]
    out: list[str | None] = [None, "", "   ", "one", "one", "One two", "\n\n", "a" * 700, "ab " * 400]
    for text in base:
        for _ in range(6):
            parts = text.split(" ")
            for _ in range(rng.randrange(0, 5)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            out.append(rng.choice(["", "", text[:60] + "\n"]) + " ".join(parts))
    out += [base[0]] * 4 + ["#$ line\nother\n#$ line\n" + base[1]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k != 3 else None, t, [None, "b", "a", "a", "a"][k % 5], 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _base(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    threes = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def test_quality_base_rules(spark, docs, texts):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(10, 60)] + [(61, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).select("row.doc_id", "row.n_words", "q.*").collect()
    assert len(got) == len(texts)
    for r in got:
        if r[0] is not None:
            assert tuple(r[2:8]) == _base(texts[r[0]]), r[0]
            assert r[1] == 7  # a column of the same name is carried along
            assert not (r.base_failed and r.kept)


def test_quality_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, none).where("q.kept = q.base_failed").count() == 0
    assert quality.quality(empty, none).count() == 0


def test_quality_model_prefers_the_target(spark):
    rng = random.Random(1)
    good, bad = ([f"{w}{i}" for i in range(80)] for w in "gb")
    rows = [(k, " ".join(rng.choices(good if k % 4 else bad, k=90))) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400) if k % 4], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).select("row.doc_id", "q.kept").collect()}
    assert not any(kept[k] for k in range(0, 400, 4))
    assert sum(kept[k] for k in range(400) if k % 4) > 290


def test_top_k_by_hand_and_sql(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vector_search, "SHARD", 40)
    monkeypatch.setattr(vector_search, "LEAF", 4)
    monkeypatch.setattr(vector_search, "BLOCK", 2)
    con = connect(sf_dir)
    assert difference(spark_rows(vector_search.op2(spark, sf_dir)), duck_rows(con, vector_search.OP2_SQL)) is None
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [-1.0, 0.5])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 6, -65536)]
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe._public()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_merging_by_rank(tokenizer):
    path, pattern = bpe._public()
    e = bpe.Encoder(bpe.read_ranks(path), pattern)
    rng = random.Random(2)
    odd = ["", " ", " a", "a ", "a  b \n c", "a  b", "x" * 3000, "=-" * 700, "don't 1234567 !!!", "<|endoftext|>", "日本語🙂👩‍👩‍👧", "\x00\x01ÿ"]
    odd += ["".join(rng.choice(["the", "ing", " ", "  ", "\n", "é", "ß", chr(rng.randrange(33, 0x3000))]) for _ in range(60)) for _ in range(300)]
    for text in odd:
        ids = tokenizer.encode_ordinary(text)
        assert e.encode(text) == " ".join(map(str, ids)), text[:60]
        assert "".join(bpe.decode(list(map(str, ids)), e.vocabulary, 3)) == text


def test_bpe_query(spark, docs, empty, texts, tokenizer):
    got = {r.doc_id: r for r in bpe.encode_documents(docs, *bpe._public()).collect()}
    for k, text in enumerate(texts):
        if k != 3:
            ids = tokenizer.encode_ordinary(text or "")
            assert got[k].n_tokens == len(ids)
            assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, *bpe._public()).count() == 0


def test_utf8_stream_keeps_unfinished_characters():
    stream, data = bpe.Utf8Stream(), "aé日🙂".encode()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) == "aé日🙂"
    assert stream.feed("🙂".encode()[:2]) == "" and stream.end() == "�"


def test_token_counts_by_section(docs, empty, texts, tokenizer):
    got = collections.defaultdict(list)
    for r in token_counts.count_tokens(docs, *bpe._public()).orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r)
    for k, text in enumerate(texts):
        if k == 3:
            continue
        text = text or ""
        parts = [p for p in re.split(r"(?<=\n)", text) if p] or [""]
        assert [r.n_chars for r in got[k]] == [len(p) for p in parts]
        assert sum(r.n_tokens for r in got[k]) == len(tokenizer.encode_ordinary(text))
        offsets = tokenizer.decode_with_offsets(tokenizer.encode_ordinary(text))[1] if text else []
        for r in got[k]:
            assert r.n_tokens == sum(r.first_char <= o < r.first_char + r.n_chars for o in offsets)
    assert token_counts.count_tokens(empty, *bpe._public()).count() == 0


def test_secrets_are_found_and_masked(spark, docs, empty):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = []
    for k in range(120):
        s = [f'token = "{key(40)}"', f"password={key(18)}", f"mail{k}.x@host{k}.example.com", f"45{k:014d}"][k % 4]
        rows.append((k, f"some words {s} and more {s}" if k % 3 else f"plain {s}", "src"))
    table = spark.createDataFrame([*rows, (200, None, None), (201, "", "s"), (201, "no secret here", "s")], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in secret_scan.scan(table).select("*", secret_scan.redacted(F.col("text"), F.col("_found")).alias("masked")).collect()}
    for k, text, _ in rows:
        assert (secret_scan.MASK in out[k].masked) == (k % 4 < 2), text
        assert not re.search("[0-9a-f]{18}", out[k].masked) or k % 4 > 1
    assert out[200].masked is None and out[201]._found == []
    assert secret_scan.stage(spark, docs, "").columns == docs.columns
    assert secret_scan.scan(empty).count() == 0


def test_training_findings_are_drawn_by_label(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "FINDINGS", 40)
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f"see mail{k}.long@host{k}.example.com or 45{k:014d} now", "s") for k in range(1500)]
    rows += [(k, "call 49170123456789 now", "s") for k in range(1500, 2000)] + [(k, f'token = "{key(k)}" it', "s") for k in range(2000, 2003)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert secret_scan.train(secret_scan.weak_findings(table)) is not None
    masked = {r.doc_id: r.m for r in secret_scan.scan(table).select("doc_id", secret_scan.redacted(F.col("text"), F.col("_found")).alias("m")).collect()}
    assert [k for k, m in sorted(masked.items()) if secret_scan.MASK in m] == [2000, 2001, 2002]


def test_without_both_labels_only_the_rule_marks(spark):
    rows = [(1, "mail12.long@host12.example.com 4512345678901234 ord3r-n0-77x9a1", "s"), (2, "nothing", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert secret_scan.train(secret_scan.weak_findings(table)) is None
    found = {r.doc_id: r._found for r in secret_scan.scan(table).collect()}
    assert len(found[1]) >= 3 and not any(c.secret for c in found[1])
    keyed = spark.createDataFrame([(1, "token = 0123456789abcdef0123", "s")], "doc_id long, text string, source string")
    assert [c.secret for c in secret_scan.scan(keyed).first()._found] == [True]


def test_secrets_inside_words(spark):
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    forms = ['{{"api_key":"{0}"}}', '{{"a":1,"token":"{0}","b":2}}', "connect(token='{0}')", "S3_KEY='{0}'", "https://x.example.com/a?id=7&token={0}&b=2", '{{"token": "{0}"}}']
    rows = [(k, f"some words {forms[k % 6].format(key(k))} and more", "s") for k in range(140)]
    rows += [(k, f'then token = "{key(k)}" and mail{k}.x@host{k}.example.com or 45{k:014d}', "s") for k in range(140, 400)]
    plain = "the red car, hunter2 it is; {} and so on"
    short = ["password=hunter2", 'password: "s3cret9"', "api_key=QwErTzUiOpAsDfGhYx", "pwd=ab12cd"]
    rows += [(k, plain.format(short[k % 4]), "s") for k in range(400, 480)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    masked = {r.doc_id: r.m for r in secret_scan.scan(table).select("doc_id", secret_scan.redacted(F.col("text"), F.col("_found")).alias("m")).collect()}
    url = spark.range(1).select(F.explode(secret_scan.candidates(F.lit(f"see https://bob:{key(0)}@host.example.com/"))).alias("c")).select("c.*")
    assert (key(0), "//bob:") in [tuple(r) for r in url.collect()]  # the forest judges it
    for k, text, _ in rows:
        if k < 400:
            assert masked[k] == text.replace(key(k), secret_scan.MASK), text
        else:
            value = re.search(r"[=:] ?\"?(\w+)", text)[1]
            assert masked[k] == plain.format(short[k % 4].replace(value, secret_scan.MASK)), text


def _removed(data: list[bytes], length: int) -> list[tuple]:
    count = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [20, 50])
def test_repeats_by_hand(docs, texts, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, length).collect()}
    for k, want in enumerate(_removed([(t or "").encode() for t in texts], length)):
        assert k == 3 or got[k] == want, k


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty).count() == 0


def test_mix_comes_near_its_targets(spark, docs, empty):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 300)), ["a", "b", "c", "d", None][min(k % 11, 4)]) for k in range(1500)]
    table = spark.createDataFrame([*rows, (7, None, "a"), (None, "x y", "b"), (None, "x y", "b")], "doc_id long, text string, source string")
    got = mixing.mix(table).select("row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == 1503
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weight = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    want, full = {}, set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        want = {s: 2.0 * size[s] if s in full else w * level for s, w in weight.items()}
        over = {s for s in weight if want[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)
    again = sorted(map(str, mixing.mix(table.repartition(7)).select("row.doc_id", "size", "taken").collect()))
    assert again == sorted(map(str, mixing.mix(table).select("row.doc_id", "size", "taken").collect()))
    assert mixing.mix(empty).count() == 0
    assert set(mixing.stage(spark, docs, "").columns) == set(docs.columns)


def test_calls_are_linked_in_order(spark):
    calls = [
        ("c1", 1, 0, "reply", '{"turn": 1, "text": "x"}', None),
        ("c2", 1, 2, "reply", '{"text": "b", "turn": 2}', "c1"),
        ("c3", 1, 4, "reply", '{"text": 5, "turn": 2}', "c2"),
        ("c4", 1, 6, "other", "{}", "gone"),
        ("c5", 1, 7, "reply", "no json", "c6"),
        ("c6", 1, 8, None, None, "c5"),
        ("c1", 1, 9, "reply", "{}", None),
        (None, 1, 9, "reply", "{}", None),
    ]
    results = [("c1", 1, "late"), ("c1", 0, "first"), ("lost", 3, "r"), (None, 1, "n")]
    table = chat.link(
        spark.createDataFrame(calls, "call_id string, conv_id long, turn long, name string, arguments string, parent string"),
        spark.createDataFrame(results, "call_id string, turn long, content string"),
    )
    got = {r.call_id: r for r in table.collect()}
    assert {k: r.level for k, r in got.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": 0, "c5": None, "c6": None, "lost": None}
    assert {k for k, r in got.items() if r.valid} == {"c1", "c2"}
    assert (got["c1"].n_calls, got["c1"].n_results, got["lost"].n_calls) == (2, 2, 0)
    want = {"arguments": {"text": "x", "turn": 1}, "call_id": "c1", "depends_on": None, "level": 0, "name": "reply", "result": "first"}
    assert got["c1"].record == json.dumps(want, separators=(",", ":"))


def test_turns_as_calls(spark, sf_dir):
    out = chat.op8(spark, sf_dir)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert out.where("n_calls > 0").count() == turns.where("role = 'user'").select("conv_id", "turn").distinct().count()
    assert out.where("level IS NULL AND n_calls > 0").count() == 0
    nothing = turns.limit(0)
    assert chat.link(*chat.turns_as_calls(nothing)).count() == 0


def _classes(texts: dict[int, str | None]) -> tuple[dict, dict]:
    sets = {}
    for k, t in texts.items():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("turns", [1, 3])
def test_jaccard_classes(docs, texts, turns, monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE", 300)
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rows = {k: t for k, t in enumerate(texts) if k != 3}
    classes, sizes = _classes(rows)
    got = {r.doc_id: r for r in near_copies.jaccard_classes(docs.where("doc_id IS NOT NULL"), turns=turns).collect()}
    assert {k: r.component_id for k, r in got.items()} == classes
    assert {k: r.n_shingles for k, r in got.items()} == sizes
    assert len(set(classes.values())) < len(classes) - 20


def test_jaccard_stage_and_empty(spark, docs, empty):
    assert near_copies.jaccard_classes(empty).count() == 0
    kept = near_copies.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.where("text = 'one'").count() == 1


def test_page_text(spark):
    article = "<article class='p-{0}'><header><h1>T{0} &amp;&nbsp;co</h1></header><div class=body><p>Long text, really <a href=x>long</a>.<br>more<p>two\n  lines</div><div class=comments><p>me too!</div></article>"
    around = "<html><head><title>t</title><script>if(a<b)</script></head><body><header>site</header><nav><p>menu</nav><div class='cookie-notice'>We use</div>{0}<aside>side</aside><footer>&copy;</footer>"
    rows = [(k, f"http://h.example/{k}", around.format(article.format(k))) for k in range(5)]
    rows += [(9, "http://h.example/x", "<body><div><p>" + "free text " * 90 + "</div>" + article.format(9)), (10, None, None), (11, "x", ""), (12, "http://o.example", "<p>cut <a href='"), (9, "http://h.example/x", "plain")]
    got = collections.defaultdict(list)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert got[3] == ["T3 & co\n\nLong text, really long. more\n\ntwo lines"]
    assert sorted(got[9])[0].startswith("T9 & co") and sorted(got[9])[1] == "plain"  # the host's path wins over the page's own best
    assert got[10] == got[11] == [""] and got[12] == ["cut"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_text_outside_one_container(spark):
    lead, body = "Lead words of it. " * 3, "Body words of it. " * 20
    post = "<body><nav>menu</nav><div class=wrap><div class=post><h1>Head {0}</h1><div class=lead><p>{1}</div><div class=body><p>{2}</div></div><div class=box><p>{3}<a href=x>{4}</a></div></div></body>"
    rows = [(k, "http://h.example/", post.format(k, lead, body, "", "some other page to read " * 9)) for k in range(5)]
    other = "<body><div class=wrap><div class=post><p>small box</div></div><div class=story><h2>Story</h2><p>{0}</div></body>"
    rows.append((9, "http://h.example/", other.format(body)))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "\n\n".join(["Head 3", lead.strip(), body.strip()])
    assert "Story" in got[9] and body.strip() in got[9]
