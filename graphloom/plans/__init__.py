"""Registered queries over the table graph, each with the SQL that checks it, and plan inspection."""
