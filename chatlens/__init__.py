"""Spark operators for analysing tables of chatbot conversations."""
