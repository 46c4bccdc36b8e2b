"""Lineage answers by walking dictionaries, for comparison on small trees."""

ROOT_LABEL, INVALID = "Taxonomy_Tree_Root", "Invalid_TaxID"


class Walker:
    def __init__(self, tree):
        self.node = {}
        for taxid, name, parent, rank in sorted(tree, key=lambda r: (r[2], r[3], r[1])):
            self.node.setdefault(taxid, (name, parent, rank))

    def chain(self, x):
        """(ids from x upwards without repeats, how it ends, last id or missing id)."""
        ids = []
        while True:
            if x not in self.node:
                return ids, "unresolved", x
            if x in ids:
                return ids, "cycle", x
            ids.append(x)
            parent = self.node[x][1]
            if parent == x:
                return ids, "top", x
            x = parent

    def ancestor(self, x, rank):
        ids, end, last = self.chain(x)
        for i in ids:
            if self.node[i][2].lower() == rank:
                return i, "found"
        if end == "unresolved" and rank == "no rank":
            return last, "found"
        return (last, "top") if end == "top" else (-1, end)

    def label(self, x, rank):
        ids, end, last = self.chain(x)
        for i in ids:
            if self.node[i][2].lower() == rank:
                return ROOT_LABEL if i == 1 and x != 1 else self.node[i][0]
        if last == 1 and x != last or (end == "top" and last == 1):
            return ROOT_LABEL
        if end == "unresolved" and rank == "no rank":
            return "unknown"
        return INVALID

    def steps(self, x):
        ids, end, last = self.chain(x)
        if end == "unresolved":
            ids = ids + ([last] if last == -1 else [last, -1])
        blank = ("unknown", None, "no rank")
        return [
            (d, i, self.node.get(i, blank)[2], self.node.get(i, blank)[0], end)
            for d, i in enumerate(ids)
        ]

    def above(self, x):
        ids, end, last = self.chain(x)
        return ids[1:] + ([last] if end == "unresolved" else [])
