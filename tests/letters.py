"""An encoder for tests: how often each letter occurs."""

import numpy as np

made = 0


def make():
    global made
    made += 1
    return lambda texts: np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float).reshape(len(texts), 26)
