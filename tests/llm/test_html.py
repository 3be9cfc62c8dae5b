"""Pages whose containers and elements mislead."""

import pytest

from docquarry.llm.html_text import main_text

WORDS = "The harbour is deep enough for large ships and has two long piers of stone. "
CARD = "<article><h2>Card</h2><p>Another story that a reader might like to open next.</p></article>"
BODY = f"<article><h1>Harbours</h1><p>{WORDS * 3}</p><p>{WORDS * 2}Last words.</p></article>"


@pytest.mark.parametrize("odd", ['<svg width="1"/>', "<svg/>", "<math/>", '<svg viewBox="0 0 > 1" />', "<svg><path d='x'/></svg>", "<math><mi>x</mi></math>"])
def test_elements_that_close_themselves(odd):
    text = main_text(f"<html><body><article><p>{WORDS}</p><p>before {odd} after</p><p>{WORDS}End.</p></article></body></html>")
    assert text.split("\n")[1] == "before after" and text.endswith("End.")


def test_a_script_does_not_close_itself():
    assert "x = 1" not in main_text(f"<article><p>{WORDS}</p><script src='a'/>x = 1</script><p>End.</p></article>")


@pytest.mark.parametrize("box", ['div class="sidebar"', 'section class="related"', 'div class="advert"', 'div id="recommended"'])
@pytest.mark.parametrize("first", [True, False])
def test_cards_beside_the_article(box, first):
    card = f"<{box}>{CARD}<h1>More</h1></{box.split()[0]}>"
    page = f"<html><body>{card if first else ''}{BODY}{'' if first else card}</body></html>"
    text = main_text(page)
    assert text.startswith("Harbours") and text.endswith("Last words.") and "Card" not in text and "More" not in text


def test_an_article_in_a_misnamed_container():
    """Without more marked text elsewhere the mark inside counts."""
    text = main_text(f'<html><body><div class="widget">{BODY}</div><p>Footer words.</p></body></html>')
    assert text.startswith("Harbours") and text.endswith("Last words.")


def test_a_notice_of_any_size():
    notice = f'<div class="cookie-consent"><p>{"We use cookies to remember what you chose. " * 30}</p></div>'
    text = main_text(f"<html><body>{notice}<h1>Harbours</h1><p>{WORDS * 2}</p><p>{WORDS}Last words.</p></body></html>")
    assert "cookies" not in text and text.endswith("Last words.")


def test_long_empty_and_repeated_pages(spark):
    from docquarry.llm.html_text import extract

    long = "<article>" + "".join(f"<p>{WORDS}{k}</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (None, None, None, None), (2, "v", "", "y")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["n_chars"], len(r["text"])) for r in got)[:2] == [(0, 0), (0, 0)] and [r["text"].count("\n") for r in got if r["page_id"] == 1] == [19_999] * 2
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
