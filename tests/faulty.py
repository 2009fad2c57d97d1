"""Offline providers that fail on some requests."""

from quern import providers as M


class FaultyParser(M.LexiconParser):
    """Fails on some queries, and has too long an intent for others."""

    def parse(self, query: str) -> dict:
        if query.startswith("a"):
            raise M.ProviderError("no intent")
        if query.startswith("b"):
            raise M.MissingKeyError("no key")
        return super().parse(query) | ({"retrieval_text": "long " * 300} if query.startswith("c") else {})


class FaultyEmbedder(M.HashEmbedder):
    """One vector for all texts; a request with a text that begins with d fails whole."""

    def embed(self, texts: list[str]):
        if any(t.startswith("d") for t in texts):
            raise M.ProviderError("no vectors")
        return [[1.0] + [0.0] * (self.dimensions - 1)] * len(texts)


class FaultyExplainer(M.TemplateExplainer):
    def explain(self, prompt: str, ranks: list[int]) -> list[tuple[int, str]]:
        if "original_query: e" in prompt:
            raise M.ProviderError("no explanations")
        return super().explain(prompt, ranks if "original_query: f" not in prompt else [r + 1 for r in ranks])
