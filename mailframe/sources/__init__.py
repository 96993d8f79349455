"""Where mails come from."""
