"""Interval labels and selectors against a parser with a stack."""

import random
import re

import pytest

from lexigrove.operators import elements


def parsed(html):
    """(start, end, depth, parent, name) of well-formed markup, by a stack."""
    out, stack = [], []
    for seq, raw in enumerate(re.findall(r"<[/]?[A-Za-z][^<>]*>|[^<]+", html)):
        if raw.startswith("</"):
            start, depth, parent, name = stack.pop()
            out.append((start, seq, depth, parent, name))
        elif raw.startswith("<"):
            name = re.match(r"<([\w:.-]+)", raw)[1].lower()
            at = (seq, len(stack) + 1, stack[-1][0] if stack else None, name)
            if raw.endswith("/>") or name in elements.VOID:
                out.append((seq, seq, *at[1:]))
            else:
                stack.append(at)
    return sorted(out)


def grown(rng, depth=0):
    name = rng.choice(["a", "b", "div", "doc", "p"])
    if rng.random() < 0.15:
        return rng.choice(["<br>", "<x k='1'/>", '<img id="i">', "text "])
    inside = "".join(grown(rng, depth + 1) for _ in range(rng.randint(0, 4) if depth < 5 else 0))
    return f'<{name} id="{rng.randint(0, 3)}">{inside or "word"}</{name}>'


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(k, "<root>" + "".join(grown(rng) for _ in range(4)) + "</root>") for k in range(30)] + [(100, None), (101, ""), (102, "no tags"), (103, "<a><a>deep</a></a>" * 300)]
    return rows, spark.createDataFrame(rows, "doc_id long, html string")


def test_labels(pages):
    rows, frame = pages
    got = {}
    for r in elements.elements(elements.events(frame, "html")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["depth"], r["parent"], r["name"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: parsed(t) for k, t in rows if t and "<" in t}


def test_paths(pages):
    rows, frame = pages
    every = elements.elements(elements.events(frame, "html"))

    def brute(path):
        out = set()
        for k, t in rows:
            found = {e[0]: e for e in parsed(t or "")}
            tags = re.findall(r"<[/]?[A-Za-z][^<>]*>|[^<]+", t or "")
            chosen = None
            for axis, names, having in elements.STEP.findall(path):
                some = {s for s, e in found.items() if e[4] in names.strip("{}").split(",")}
                for a, v in re.findall(r"\[@(\w+)='([^']*)'\]", having):
                    some = {s for s in some if f'{a}="{v}"' in tags[s]}
                if chosen is None:
                    chosen = {s for s in some if axis == "//" or found[s][2] == 1}
                elif axis == "/":
                    chosen = {s for s in some if found[s][3] in chosen}
                else:
                    chosen = {s for s in some if any(c < s < found[c][1] for c in chosen)}
            out |= {(k, s) for s in chosen}
        return out

    for path in ("//a", "/root/a", "//a//a", "//a/a/b", "/root//{a,div}/p", "//div[@id='2']//b[@id='1']", "//br", "/a", "//a//a//a", "//none"):
        assert {(r["doc_id"], r["start"]) for r in elements.selected(every, path).collect()} == brute(path), path
    for wrong in ("a", "//a[", "", "/a//"):
        with pytest.raises(ValueError, match="no selector"):
            elements.selected(every, wrong)


def test_contents(spark):
    frame = spark.createDataFrame([(1, '<div>one <div>two\n <b>three</b></div> four</div><script>"</div>"</script><!-- <div> --><p>never closed <i>x</i></q>')], "doc_id long, html string")
    told = elements.events(frame, "html")
    every = elements.elements(told)
    text = lambda path: [r["text"] for r in elements.contents(elements.selected(every, path), told).orderBy("start").collect()]
    assert text("//div") == ["one two three four", "two three"] and text("//div/div") == ["two three"] and text("//div//b") == ["three"]
    # what is never closed is empty, and a stray end ends nothing
    assert text("//p") == [""] and text("//i") == ["x"] and text("/i") == ["x"]
    assert [r["x"] for r in elements.selected(elements.elements(elements.events(spark.createDataFrame([(1, '<a HREF="/x" k = "v"><a>')], "doc_id long, html string"), "html")), "//a").orderBy("start").select(elements.value_of("href").alias("x")).collect()] == ["/x", None]
