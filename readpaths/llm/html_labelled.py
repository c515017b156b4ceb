"""Labelled pages for the extraction model, laid out by rule.

``gold="1"`` opens main content and ``gold="0"`` page furniture; descendants
inherit the mark, and what has none is frame.  The attribute is a label only:
features never see it.  Every kind of furniture stands before, after and
inside main content of every kind, with short, long and linked text.
"""

from collections.abc import Iterator
from itertools import cycle

_LONG = (
    "The committee met on Tuesday to review the plans for the new bridge, and its members agreed that the work should begin before the winter, when the river is low.",
    "Several residents, however, asked for more time. They pointed out that the last survey was ten years old, and that the banks have shifted since then.",
    "A spokesman said the engineers would publish their figures next month; until then, the old crossing stays open to light traffic, but lorries have to take the road by the mill.",
    "I drove over it last week and it was fine, honestly I do not see why everyone is so worried about this old thing. Have they looked at the other one?",
)
_MIDDLE = ("The bridge stays open until further notice.", "Great, thanks for sharing, I have said the same for years!", "See the figures below, they are from May.", "Our best offer of the year ends soon, so do not miss it.")
_SHORT = ("Yes.", "Later that day", "Figures", "12 Main Street", "All rights reserved")
_LINK = ("Home", "News", "Read more about the harbour", "Contact", "Ten places to visit this summer")


class _Text:
    """Sentences in turn."""

    def __init__(self):
        self.long, self.middle, self.short, self.link = cycle(_LONG), cycle(_MIDDLE), cycle(_SHORT), cycle(_LINK)

    def links(self, n=5):
        return "".join(f'<li><a href="/x">{next(self.link)}</a></li>' for _ in range(n))

    def inside(self, shape: int) -> str:
        """What furniture holds: long paragraphs, a short line, links, a thread, or a mix."""
        return (f"<p>{next(self.long)}</p><p>{next(self.long)}</p>", next(self.middle), f"<ul>{self.links()}</ul>",
                f"<h3>{next(self.short)}</h3>" + "".join(f'<div><p>{next(self.long)}</p></div>' for _ in range(3)),
                f"<h4>{next(self.short)}</h4><p>{next(self.middle)}</p><p><a href=\"/y\">{next(self.link)}</a></p>", f"<p>{next(self.middle)}</p>",
                f"<article><p>{next(self.long)}</p></article><article><p>{next(self.long)}</p><p>{next(self.middle)}</p></article>")[shape]

    def body(self, shape: int) -> list[str]:
        """Parts of main content."""
        p = [f"<p>{next(self.long)} {next(self.long)}</p>", f"<p>{next(self.long)}</p>", f"<p>{next(self.middle)}</p>"]
        extra = (f"<h2>{next(self.short)}</h2>", f"<ul><li>{next(self.middle)}</li><li>{next(self.short)}</li></ul>", f"<blockquote><p>{next(self.long)}</p></blockquote>",
                 f"<table><tr><th>{next(self.short)}</th></tr><tr><td>1,200</td><td>{next(self.middle)}</td></tr></table>", f"<div><p>{next(self.long)}</p></div>",
                 f"<section><h3>{next(self.short)}</h3><p>{next(self.long)}</p></section>", f"<figure><figcaption>{next(self.middle)}</figcaption></figure>",
                 f"<pre>a = b + c</pre><p>See <a href=\"/z\">{next(self.link)}</a>, {next(self.middle)}</p>", f"<div>{next(self.long)}</div>")[shape]
        return [f"<h1>{next(self.short)}</h1>", p[0], extra, p[1], p[2], f"<p>{next(self.short)}</p>"]


def pages(furniture_words: list[str], content_words: list[str]) -> Iterator[str]:
    """The labelled pages; words are the class names that tell furniture and content apart."""
    text = _Text()
    furniture = [(tag, "") for tag in ("nav", "aside", "footer", "header", "form", "dialog")] * 9 + [("div", f'class="{w}"') for w in furniture_words]
    furniture += [(t, f'id="{w}"') for t, w in zip(cycle(("section", "div", "ul", "aside")), furniture_words, strict=False)] + [("div", "")] * 7
    content = [("article", ""), ("main", ""), ("div", "")] + [(t, f'class="{w}"') for t, w in zip(cycle(("div", "section", "article", "main")), content_words, strict=False)]
    mains = cycle(content)
    for i, (tag, names) in enumerate(furniture):
        (main, main_names), plain = next(mains), not names and tag == "div"
        block = f'<{tag} {names} gold="0">{f"<ul>{text.links()}</ul>" if plain or tag == "ul" else text.inside(i % 7)}</{tag}>'
        other = f'<{furniture[(i + 7) % len(furniture)][0]} {furniture[(i + 7) % len(furniture)][1]} gold="0">{text.inside((i + 2) % 6)}</{furniture[(i + 7) % len(furniture)][0]}>'
        parts = text.body(i % 9)
        if i % 4 == 0 and not plain and tag != "header":  # furniture inside the main content
            parts.insert(3, block)
            block = ""
        elif i % 4 == 1 and not plain and tag != "header":
            parts.append(block)
            block = ""
        if i % 5 == 0:
            parts[0] = f"<header>{parts[0]}</header>"
        if i % 6 == 0:
            parts[1] = parts[1].replace("<p>", "<p><b>").replace("</p>", "<br>")
        core = f'<{main} {main_names} gold="1">{"".join(parts)}</{main}>'
        if i % 7 == 0:
            core = f'<div class="wrapper">{core}</div>'
        elif i % 7 == 1:
            core = f"<table><tr><td>{core}</td></tr></table>" if main == "div" else f"<div><div>{core}</div></div>"
        yield f"<html><body>{block if i % 2 else ''}{core}{'' if i % 2 else block}{other}</body></html>"
    for n in (1, 2, 4):  # text without any container, or in one paragraph
        for words in (" ".join(next(text.long) for _ in range(n)), next(text.short)):
            yield f'<html gold="1">{words}'
            yield f'<html><body gold="1">{words}</body></html>'
        yield "<html><body>" + "".join(f'<p gold="1">{next(text.long)}</p>' for _ in range(n)) + "</body></html>"
