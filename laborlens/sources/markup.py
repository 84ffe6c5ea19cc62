"""A small element tree over ``html.parser``, used inside tasks for one page at a time."""

from __future__ import annotations

from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children = []          # nodes and text pieces, in document order

    def walk(self):
        """All elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def pieces(self):
        """Text pieces below this element, in document order, hidden elements left out."""
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in _HIDDEN:
                stack.extend(reversed(item.children))

    def text(self, separator=""):
        return separator.join(p.strip() for p in self.pieces() if p.strip())

    def has_class(self, part):
        return part in self.attrs.get("class", "")

    def first(self, test):
        return next((n for n in self.walk() if test(n)), None)

    def all(self, test):
        return [n for n in self.walk() if test(n)]

    def ancestor(self, *tags):
        for tag in tags:
            node = self.parent
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None:
                return node
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
