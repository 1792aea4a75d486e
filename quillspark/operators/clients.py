"""A client for chat services that speak JSON over HTTP, for ``annotations.call``."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class ChatClient:
    """Sends a prompt as the user's message and returns the first answer's text.

    The key is read on the worker from the environment variable ``key_from``, so it is in no plan and no log. Busy and
    failing services (429, 5xx, no connection, timeout) are asked again after a wait that doubles; other errors are raised.
    """

    url: str
    model: str
    key_from: str = "CHAT_API_KEY"
    temperature: float = 0.0
    timeout: float = 120.0
    tries: int = 3
    wait: float = 1.0
    most_tokens: int = 8000

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.most_tokens, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.key_from):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as error:
                if not left or (error.code != 429 and error.code < 500):
                    raise
            except OSError:
                if not left:
                    raise
            time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        raise ValueError("tries must be positive")

    def connect(self) -> ChatClient:
        return self
