"""Queries over documents read whole texts: what stands far behind the start is found."""

import re

from lectern import plans

FILL = "words of no note go on here and there; " * 30


def stated(text):
    """Names stated in a text, word by word: (kind, value), two of a kind at most, one title."""
    words, out = list(re.finditer(r"\S+", text)), []
    for i, m in enumerate(words):
        if m.group() != "by":
            continue
        name = []
        for w in words[i + 1 : i + 5]:
            name.append(w.group().rstrip(".,;"))
            if not name[-1][:1].isupper():
                name.pop()
                break
            if w.group()[-1] in ".,;":
                break
        read = i > 0 and words[i - 1].group().lower() in ("narrated", "read", "performed", "voiced")
        if name:
            out.append(("narrator" if read else "author", " ".join(name)))
    out = [x for k in ("author", "narrator") for x in [y for y in out if y[0] == k][:2]]
    title = re.search(r"\bThis is ([^,.;]{1,50})[,.;]", text)
    return out + ([("title", title.group(1))] if title else [])


def test_past_any_prefix(spark, tmp_path):
    texts = [
        FILL + "This is The Far End, written by Mary Shelley, narrated by Jo March and told again.", FILL * 3 + "A tale by Tom Hood, read by Al Bo Ek.",
        "by Ann Lee. " + FILL + "also by Bo Ek; and by Cy Day.", FILL, "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = plans.queries()["stated_names"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.kind, r.value) for r in rows) == sorted((i, k, v) for i, t in enumerate(texts) for k, v in stated(t or ""))
    parts = {r.doc_id: r.parts for r in plans.queries()["split_text"](spark, str(tmp_path)).collect()}
    assert [parts[i] for i in range(5)] == ["#".join(p.strip() for p in re.split("[;/,|]", t) if p.strip()) for t in texts[:5]]
    clean = {r.doc_id: r.q for r in plans.queries()["sanitised_text"](spark, str(tmp_path)).collect()}
    assert [clean[i] for i in range(5)] == [" ".join(re.sub(r"[^\w'-]+", " ", t).split()) for t in texts[:5]]
