"""Reports of mail files as JSON, one a line: spark-submit --py-files mailframe.zip mailreport.py -i s3a://bucket/mails -o s3a://bucket/reports"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from mailframe.config import Options
from mailframe.operators import report
from mailframe.sources import mail


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Reports of mail files as JSON, one a line.")
    listed = {"type": lambda text: tuple(x.strip() for x in text.split(",") if x.strip()), "default": ()}
    out.add_argument("-i", dest="path", required=True, help="file, folder or pattern, in any store that Spark reads")
    out.add_argument("-o", dest="out", help="new folder for gzipped text files; without it reports are printed, one partition at a time")
    out.add_argument("-d", dest="raw_body", action="store_true", help="texts and indicators as they are, not hashed")
    out.add_argument("-r", dest="attachment_data", action="store_true", help="with the data of attachments (base64)")
    out.add_argument("-w", dest="ip_whitelist", **listed, help="IPs to leave out, separated by commas")
    out.add_argument("-f", dest="for_whitelist", **listed, help="addresses to leave out of `for` in the path, separated by commas")
    out.add_argument("-b", dest="entry_hosts", **listed, help="hosts whose `by` marks the entry into one's own network, separated by commas")
    out.add_argument("--email-force-tld", dest="email_needs_tld", action="store_true", help="only addresses with a dot in their host")
    out.add_argument("--skip-bad-start", dest="skip_bad_start", action="store_true", help="drop junk lines before the headers")
    out.add_argument("--glob", default="*", help="names of files to read in a folder")
    out.add_argument("--recursive", action="store_true", help="with folders below")
    out.add_argument("--pretty", action="store_true", help="indented, when printed")
    return out


def main(argv: list[str] | None = None) -> None:
    args = vars(arguments().parse_args(argv))
    path, out, glob, recursive, pretty = (args.pop(k) for k in ("path", "out", "glob", "recursive", "pretty"))
    options = Options(**args)
    spark = SparkSession.builder.getOrCreate()
    messages = mail.parse_mails(mail.files(spark, path, glob, recursive), options)
    lines = report.to_json(report.report(messages, options), pretty and not out).select("json")
    if out:
        lines.write.option("compression", "gzip").text(out)
    else:
        for row in lines.toLocalIterator():
            print(row.json)


if __name__ == "__main__":
    main()
