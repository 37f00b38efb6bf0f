"""Columns that a caller's table may have too."""

#: Names of columns that operators make for themselves.
HELPERS = "s whole blocks lo lp rest k t o p copies at b es ls bs gone kept n_gone id row_key fingerprint window windows line pairs hashes words from_id from_key d times first best class component node once id_key key row block home low n gram total lang perplexity cut threshold keep bucket c0 c1 one tokens l u v m __maybe".split()
