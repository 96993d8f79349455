"""Options of a parse, as one immutable value; nothing is switched for the whole process."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """raw_body: indicators and text as they are, not hashed. attachment_data: keep payloads (base64).

    ip_whitelist, for_whitelist: values to leave out. entry_hosts: host names whose `by` marks the entry
    into one's own network. skip_bad_start: drop junk lines before the headers. email_needs_tld: addresses need a
    dot in their host. domain_needs_tld: hosts need a known public suffix. ip_routable: only global,
    unreserved addresses. suffixes: known suffixes instead of the built-in ones.
    """

    raw_body: bool = False
    attachment_data: bool = False
    ip_whitelist: tuple[str, ...] = ()
    for_whitelist: tuple[str, ...] = ()
    entry_hosts: tuple[str, ...] = ()
    skip_bad_start: bool = False
    email_needs_tld: bool = False
    domain_needs_tld: bool = False
    ip_routable: bool = False
    attachments: bool = True
    www: bool = True
    href: bool = True
    suffixes: tuple[str, ...] | None = None
