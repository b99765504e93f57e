"""A bounded memory of computed values for Python workers."""


class Recent(dict):
    """Values of ``make(key)``, at least those of the last ``kept`` different keys; what drops out is made again."""

    def __init__(self, kept: int, make):
        super().__init__()
        self.kept, self.make, self.old = kept, make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
