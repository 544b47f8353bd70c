import re
from collections import Counter

from skylattice.llm import quality as Q


def direct(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark, docs, texts):
    more = ["a b c d e a b c d e", "a b c d e x a b c d e a b c d e", "#|<>\nx y\nx y\n\n\nx y", "a a a a a a a", "\x1cx \x85 y"]
    df = docs.select("doc_id", "text", "source", "fp").unionByName(spark.createDataFrame([(100 + i, t, "s") for i, t in enumerate(more)], "doc_id long, text string, source string"), allowMissingColumns=True)
    rows = Q.quality(df).collect()
    assert len(rows) == df.count()
    got = {r["doc_id"]: r for r in rows}
    for i, t in [*enumerate(texts), *[(100 + i, t) for i, t in enumerate(more)]]:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == direct(t), t
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_frequent_lines(spark):
    line = "Subscribe to our newsletter for   more of it today"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(i, f"{line.upper()}\n{body(i)}", "a") for i in range(30)] + [(100 + i, f"{line}\nx{i} y z", "a") for i in range(5)] + [(200, f"{line}\n{body(200)}", "b"), (None, f"{line}\nq r s", "a")]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["kept"] and by[0]["removed_chars"] == len(re.sub(" +", " ", line)) and not by[100]["kept"] and not by[None]["kept"]
    assert by[200]["removed_chars"] == 0 and by[200]["kept"]


def test_documents_count_by_id_and_host(spark):
    line = "Subscribe to our newsletter for more of it today"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    # One id in many rows is one document; a null host and the empty one are two hosts.
    rows = [(1, f"{line}\n{body(1)}", "a")] * 30 + [(100 + i, f"{line}\n{body(i)}", None) for i in range(15)] + [(200 + i, f"{line}\n{body(i)}", "") for i in range(15)]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(r["removed_chars"] == 0 and r["kept"] for r in got)
    # The same id and text under a host where the line is frequent and one where it isn't.
    rows = [(i, f"{line}\n{body(i)}", "a") for i in range(30)] + [(3, f"{line}\n{body(3)}", "b")]
    removed = sorted(r["removed_chars"] for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r["doc_id"] == 3)
    assert removed == [0, len(line)]


def test_empty(empty):
    assert Q.quality(empty).count() == 0
