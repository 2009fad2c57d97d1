"""A client with the calls that the models make; its answers follow the offline models."""

import os
from types import SimpleNamespace as N

import numpy as np

from quern import providers as M

ASKED = "FAKE_CLIENT_LOG"


class Intent:
    pass


class Explanations:
    pass


def connect(key):
    """A client for ``key``; what it is asked goes to the file that the environment names."""

    def told(line):
        with open(os.environ[ASKED], "a") as f:
            f.write(f"{key} {line}\n")

    def create(model, input, dimensions, encoding_format, timeout):
        told(f"embed {model} {dimensions} {len(input)} {timeout}")
        rows = M.HashEmbedder(dimensions).embed(input)
        return N(data=[N(index=i, embedding=np.asarray(r).tolist()) for i, r in reversed(list(enumerate(rows)))], usage=N(prompt_tokens=len(input), total_tokens=len(input)))

    def parse(model, input, text_format):
        told(f"parse {model} {text_format.__name__}")
        user = input[1]["content"]
        if text_format is Intent:
            return N(output_parsed=N(**M.LexiconParser().parse(user.removeprefix("Shopper query: "))))
        ranks = [int(line.split()[2].rstrip(":")) for line in user.splitlines() if line.startswith("Product rank ")]
        return N(output_parsed=N(explanations=[N(rank=r, why_this_matches=f"by {model}") for r in ranks]))

    return N(embeddings=N(create=create), responses=N(parse=parse))
