import pytest

from quillstone.llm import html

BODY = "<div><p>The river runs past the old mill and turns south near the bridge where boats are kept.</p></div>"
WANT = "The river runs past the old mill and turns south near the bridge where boats are kept."


@pytest.mark.parametrize(
    "start",
    [
        "<head><title>T</title></head><body>",
        "<head><title>T</title><body>",
        "<html><head><meta charset=utf-8><title>T</title><script>x()</script><body class='page'>",
        "<head><title>T</title><link rel=a href=b>",
        "<!doctype html><html><head>\n<style>p {}</style>\n",
        "<head><head><title>T</title>",
    ],
)
def test_head_without_its_end(start):
    assert html.extract_text(start + BODY) == WANT


def test_bare_words_end_a_head():
    assert html.extract_text("<head><title>T</title>" + WANT) == WANT
