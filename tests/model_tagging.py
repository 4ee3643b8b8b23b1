"""The tagging rule stated over whole texts: mentions, then boundaries, then cuts."""

import re

BEGIN = re.compile(r'^|(?<=[ \t\n"(])')
STOP = r'(?=[ \t\n"):?!.]|\Z)'


def tag_text(text, start_ticker, terms):
    """(ticker, text) segments of ``text``; ``terms`` maps term -> ticker."""
    begins = [m.start() for m in BEGIN.finditer(text)]
    patterns = [(len(term), ticker, re.compile(re.escape(term) + STOP)) for term, ticker in terms.items()]
    mentions = sorted((b, n, ticker) for n, ticker, p in patterns for b in begins if p.match(text, b))
    tickers = [ticker for _, _, ticker in mentions]
    before = [start_ticker or (tickers[0] if tickers else "")] + tickers
    cuts = [(pos, new) for (pos, _, new), old in zip(mentions, before) if new != old]
    edges = [0, *(pos for pos, _ in cuts), len(text)]
    owners = [before[0], *(new for _, new in cuts)]
    segments = [(owner, text[a:b]) for owner, a, b in zip(owners, edges, edges[1:])]
    return segments if segments[-1][1] else segments[:-1]
