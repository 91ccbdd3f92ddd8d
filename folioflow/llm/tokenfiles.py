"""Where tokenizer files are: a parameter, the installed ``public_tokenizers`` package by default."""

from __future__ import annotations

import importlib.util
import os

HOME = "/opt/tokenizers"

def token_file(name: str, home: str | None = None) -> str:
    if home is not None:
        return os.path.join(home, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(HOME, name)



class Memo(dict):
    """What ``make`` gives for a key, remembered for ``most`` keys at a time; missing keys are made on
    access, so ``map(memo.__getitem__, keys)`` runs without Python code on hits. Keys of more than
    ``longest`` characters are made anew each time, so the memory is bounded in bytes, too."""

    def __init__(self, make, most: int = 1 << 19, seed: dict | None = None, longest: int = 64) -> None:
        super().__init__(seed or {})
        self.make, self.most, self.seed, self.longest = make, most, seed or {}, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most + len(self.seed):
            self.clear()
            self.update(self.seed)

        value = self[key] = self.make(key)
        return value
