"""Texts from columns, strings and binary files, and stored indexes."""
