"""Conversation and panel text analytics on Spark."""
