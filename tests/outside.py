"""What stands outside the library in tests, importable where Spark runs it: recognisers of pages and a provider of replies."""

import os
import uuid

from parchment.sources.scan import Unavailable


def lines(data: bytes, kind: str):
    body = data.split(b"\n", 1)[1].decode() if b"\n" in data else ""
    if "broken" in body:
        raise ValueError("bad page")
    return [{"text": line, "tsv": f"level\tconf\ttext\n5\t90\t{line}", "width": 100, "height": 50, "has_image": "image" in line} for line in body.splitlines()]


def missing(data: bytes, kind: str):
    raise Unavailable("no such program")


class Fake:
    """A provider that notes each prompt in a folder, and answers by the prompt's first word."""

    def __init__(self, folder, quota_after=None):
        self.folder, self.quota_after = folder, quota_after

    def __call__(self, prompt):
        seen = [f for f in os.listdir(self.folder) if f.startswith(prompt + "~")]
        if self.quota_after is not None and len(os.listdir(self.folder)) >= self.quota_after:
            return 429, "Tokens per day", None, None
        open(f"{self.folder}/{prompt}~{uuid.uuid4()}", "w").close()
        kind = prompt.split("-")[0]
        if kind == "flaky" and not seen:
            return 503, None, None, None
        if kind == "limited" and not seen:
            return 429, "slow down", None, "0.01"
        if kind == "bad":
            return 400, "no", None, None
        return (200, None, "", None) if kind == "mute" else (200, None, f"reply to {prompt}", None)
