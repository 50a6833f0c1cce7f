"""A feed of numbered entries whose lengths stand in the file of the option `ends`, so that a test can let it grow."""

import json

from scoutlake.sources.fetchers import Feed


class Numbered(Feed):
    def end(self, channel):
        with open(self.options["ends"]) as f:
            return json.load(f)[channel]

    def entries(self, channel, first, end):
        for n in range(first, end):
            yield {"title": f"{channel} {n}", "url": f"https://e.test/{channel}/{n}"}
