"""Command line: serve suggestions over HTTP from a file of lines."""

from __future__ import annotations

import argparse
import sys
import tempfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

MOST_URL = 2048


def make_handler(service):
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            if len(self.path) > MOST_URL:
                self.close_connection = True
                return
            answer = service.handle(self.path)
            body = answer.body.encode("utf-8", "surrogateescape")
            self.send_response(answer.status, answer.reason)
            for name, value in {**answer.headers, "Content-Length": str(len(body))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        do_POST = do_GET

        def log_message(self, *args):
            pass

    return Handler


def options(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexiloom")
    p.add_argument("-f", "--file", help="lines of weight, tab, phrase and, if any, tab, snippet")
    p.add_argument("-p", "--port", type=int, default=6767)
    p.add_argument("-l", "--limit", type=int, default=-1, help="lines to read at most")
    p.add_argument("--store", default=None, help="folder for corpus versions; on a cluster a shared one")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from lexiloom.service import SuggestService

    o = options(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    if not o.store and not spark.sparkContext.master.startswith("local["):
        print("--store must name a folder that all machines share", file=sys.stderr)
        return 2
    service = SuggestService(spark, o.store or tempfile.mkdtemp(prefix="lexiloom-store-"))
    if o.file:
        answer = service.import_(o.file, o.limit)
        print(answer.body, file=sys.stderr)
        if answer.status != 200:
            return 1
    ThreadingHTTPServer(("", o.port), make_handler(service)).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
