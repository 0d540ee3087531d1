"""A hand-made dump of three compressed streams."""

import bz2

HEAD = '<mediawiki xmlns="x" version="0.10"><siteinfo><sitename>Test</sitename></siteinfo>\n'


def page(title, page_id, text, redirect="", contributor="<username>U</username><id>77</id>"):
    body = "" if text is None else f'<text xml:space="preserve">{text}</text>'
    return f"  <page>\n    <title>{title}</title>\n    <ns>0</ns>\n    <id>{page_id}</id>\n    {redirect}\n    <revision>\n      <id>{page_id}00</id>\n      <timestamp>2010-01-01T00:00:00Z</timestamp>\n      <contributor>{contributor}</contributor>\n      <comment>see [[comment]]</comment>\n      {body}\n    </revision>\n  </page>\n"


STREAMS = [
    HEAD + page("A &amp; B", 1, "   leading [[Tea|the tea]] and [[tea]] &lt;b&gt; ==References== [[Green|g]] [[Category:Drinks|d]]") + page("Old Tea", 2, "#REDIRECT [[Tea]]", '<redirect title="Tea &amp; more" />'),
    page("Template:Box", 10, "box [[Tea|the tea]]") + page("Tea", 11, "[[Green Tea|the tea]] of the [[A &amp; B]] [[User talk:x]] [[:File:y]] [[Category:Plants]]", contributor="<ip>1.2.3.4</ip>"),
    page("Bare", 20, "#REDIRECT [[Tea]]", "<redirect />") + page("Empty", 21, "") + page("Portal:P", 22, "#REDIRECT [[Tea]]", '<redirect title="Tea" />') + "</mediawiki>\n",
]


def write(folder):
    """(dump path, index path, offsets)."""
    packed = [bz2.compress(s.encode()) for s in STREAMS]
    offsets = [sum(map(len, packed[:k])) for k in range(3)]
    ids = [[(1, "A & B"), (2, "Old Tea")], [(10, "Template:Box"), (11, "Tea")], [(20, "Bare"), (21, "Empty"), (22, "Portal:P")]]
    (folder / "dump.xml.bz2").write_bytes(b"".join(packed))
    lines = [f"{o}:{i}:{t}" for o, own in zip(offsets, ids) for i, t in own]
    (folder / "index.txt.bz2").write_bytes(bz2.compress(("\n".join(lines) + "\n").encode()))
    return str(folder / "dump.xml.bz2"), str(folder / "index.txt.bz2"), offsets
