"""How byte-level vocabulary files write bytes: printable ones as themselves, the others as letters from 256 on."""

_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
BYTES = {letter: b for b, letter in LETTERS.items()}
