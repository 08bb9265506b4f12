"""A web for tests: answers by address from a folder, and a log of what was asked when, over all worker processes."""

from __future__ import annotations

import json
import os
import time
import uuid

from prospecta.sources.acquire import RequestError, Response


class FakeWeb:
    """Answers are [status, text, headers] in turn, the last one for ever; others are not found; text None breaks the connection."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    @classmethod
    def made(cls, folder, answers: dict) -> FakeWeb:
        os.makedirs(f"{folder}/log", exist_ok=True)
        with open(f"{folder}/answers.json", "w") as file:
            json.dump(answers, file)
        return cls(str(folder))

    def __call__(self, url: str, timeout: float) -> Response:
        with open(f"{self.folder}/answers.json") as file:
            answers = json.load(file).get(url, [[404, "", {}]])
        now, before = time.time(), sum(x[1] == url for x in self.log())
        with open(f"{self.folder}/log/{uuid.uuid4().hex}.tmp", "w") as file:
            json.dump([now, url, os.getpid()], file)
        os.rename(file.name, file.name[:-4])
        status, text, headers = answers[min(before, len(answers) - 1)]
        if text is None:
            raise RequestError("ConnectionError: gone")
        return Response(status, text, headers)

    def log(self) -> list[list]:
        """[time, address, process] of each request, in order."""
        out = []
        for name in os.listdir(f"{self.folder}/log"):
            if not name.endswith(".tmp"):
                with open(f"{self.folder}/log/{name}") as file:
                    out.append(json.load(file))
        return sorted(out)

    def asked(self, url: str) -> int:
        return sum(x[1] == url for x in self.log())
