"""Package catalogs: the services that packages talk to, and the technologies that they show. As text, and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Kind, service, packages.
INTEGRATIONS = """
database | Prisma | @prisma/client prisma
database | PostgreSQL | pg postgres @neondatabase/serverless @vercel/postgres
database | MySQL | mysql mysql2 @planetscale/database
database | SQLite | sqlite3 better-sqlite3 @libsql/client
database | MongoDB | mongodb mongoose
database | Drizzle ORM | drizzle-orm
database | TypeORM | typeorm
database | Sequelize | sequelize
database | Knex | knex
database | Supabase | @supabase/supabase-js
database | Firebase | firebase firebase-admin
database | DynamoDB | @aws-sdk/client-dynamodb @aws-sdk/lib-dynamodb
cache | Redis | redis ioredis @upstash/redis @redis/client
cache | Memcached | memcached memjs
queue | BullMQ | bullmq bull
queue | Kafka | kafkajs
queue | RabbitMQ | amqplib
queue | AWS SQS | @aws-sdk/client-sqs
payments | Stripe | stripe @stripe/stripe-js @stripe/react-stripe-js
payments | PayPal | @paypal/checkout-server-sdk @paypal/react-paypal-js
payments | Lemon Squeezy | @lemonsqueezy/lemonsqueezy.js
email | Nodemailer | nodemailer
email | Postmark | postmark
email | SendGrid | @sendgrid/mail
email | Resend | resend
email | Mailgun | mailgun.js mailgun-js
auth | NextAuth | next-auth @auth/core @next-auth/prisma-adapter @auth/prisma-adapter
auth | Passport | passport passport-local passport-jwt passport-google-oauth20
auth | JSON Web Tokens | jsonwebtoken jose express-jwt @fastify/jwt
auth | Clerk | @clerk/nextjs @clerk/clerk-sdk-node @clerk/express
auth | Auth0 | @auth0/nextjs-auth0 auth0
auth | Password hashing | bcrypt bcryptjs argon2 @node-rs/argon2
ai | OpenAI | openai @ai-sdk/openai
ai | Anthropic | @anthropic-ai/sdk @ai-sdk/anthropic
ai | Google Gemini | @google/generative-ai @google/genai @ai-sdk/google
ai | LangChain | langchain @langchain/core @langchain/openai
ai | Vercel AI SDK | ai
storage | AWS S3 | @aws-sdk/client-s3 aws-sdk
storage | Cloudinary | cloudinary
storage | UploadThing | uploadthing
storage | Google Cloud Storage | @google-cloud/storage
search | Elasticsearch | @elastic/elasticsearch
search | Algolia | algoliasearch
search | Meilisearch | meilisearch
monitoring | Sentry | @sentry/node @sentry/nextjs @sentry/react @sentry/browser
monitoring | Datadog | dd-trace
monitoring | Vercel Analytics | @vercel/analytics
monitoring | OpenTelemetry | @opentelemetry/api @opentelemetry/sdk-node
messaging | Twilio | twilio
messaging | Slack | @slack/web-api @slack/bolt
messaging | Pusher | pusher pusher-js
messaging | Socket.IO | socket.io socket.io-client
cms | Contentlayer | contentlayer next-contentlayer
cms | Sanity | @sanity/client next-sanity
cms | Contentful | contentful
"""
#: Category, technology, packages; categories in the order that they are shown.
STACK = """
language | TypeScript | typescript
framework | Next.js | next
framework | Express | express
framework | Fastify | fastify
framework | Koa | koa
framework | Hono | hono
framework | NestJS | @nestjs/core
framework | Remix | @remix-run/node @remix-run/react
framework | Nuxt | nuxt
framework | SvelteKit | @sveltejs/kit
framework | Astro | astro
framework | Electron | electron
ui | React | react
ui | Vue | vue
ui | Svelte | svelte
ui | Angular | @angular/core
ui | Tailwind CSS | tailwindcss
ui | styled-components | styled-components
ui | Radix UI | @radix-ui/react-slot @radix-ui/react-dialog @radix-ui/react-dropdown-menu
data | Prisma | prisma @prisma/client
data | Drizzle ORM | drizzle-orm
data | TypeORM | typeorm
data | Sequelize | sequelize
data | Mongoose | mongoose
data | Knex | knex
data | Redis | redis ioredis @upstash/redis
data | TanStack Query | @tanstack/react-query
api | tRPC | @trpc/server
api | GraphQL | graphql
api | Apollo | @apollo/server @apollo/client apollo-server
api | zod | zod
api | Axios | axios
testing | Jest | jest
testing | Vitest | vitest
testing | Mocha | mocha
testing | Playwright | @playwright/test playwright
testing | Cypress | cypress
testing | Supertest | supertest
build | Vite | vite
build | webpack | webpack
build | Rollup | rollup
build | esbuild | esbuild
build | tsup | tsup
build | Turborepo | turbo
build | Nx | nx
build | Babel | @babel/core
quality | ESLint | eslint
quality | Prettier | prettier
quality | Biome | @biomejs/biome
quality | Husky | husky
"""
#: What file names show, as patterns of the path.
STACK_FILES = [
    (r"(^|/)tsconfig(\.[\w-]+)?\.json$", "TypeScript", "language"),
    (r"(^|/)Dockerfile(\.[\w-]+)?$", "Docker", "deployment"),
    (r"(^|/)(docker-)?compose(\.[\w-]+)?\.ya?ml$", "Docker Compose", "deployment"),
    (r"^\.github/workflows/", "GitHub Actions", "deployment"),
    (r"(^|/)vercel\.json$", "Vercel", "deployment"),
    (r"(^|/)netlify\.toml$", "Netlify", "deployment"),
    (r"(^|/)render\.ya?ml$", "Render", "deployment"),
    (r"(^|/)fly\.toml$", "Fly.io", "deployment"),
]
CATEGORIES = ["language", "framework", "ui", "data", "api", "testing", "build", "quality", "deployment"]


def _table(spark: SparkSession, text: str, first: str) -> DataFrame:
    rows = [(p, name.strip(), kind.strip()) for kind, name, packages in (line.split("|") for line in text.strip().splitlines()) for p in packages.split()]
    return spark.createDataFrame(rows, f"package string, name string, {first} string")


def integration_catalog(spark: SparkSession) -> DataFrame:
    """(package, name, kind)."""
    return _table(spark, INTEGRATIONS, "kind")


def stack_catalog(spark: SparkSession) -> DataFrame:
    """(package, name, category)."""
    return _table(spark, STACK, "category")
